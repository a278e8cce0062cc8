"""The stratigraphic column: units in order, groups between unconformities, and which unit a value lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.bands import case_of


def groups(column: DataFrame, order: str = "pos", unconformity: str = "unconformity") -> DataFrame:
    """Group numbers from the bottom up: each unconformity ends one. `column` is a small table."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return column.withColumn("grp", F.coalesce(F.sum(F.col(unconformity).cast("int")).over(w), F.lit(0)))


def extents(column: DataFrame, group: str = "grp", order: str = "pos", thickness: str = "thickness") -> DataFrame:
    """Lower and upper value of each unit: thickness summed from the bottom of its group."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    top = F.sum(thickness).over(w)
    return column.withColumn("vmin", top - F.col(thickness)).withColumn("vmax", top)


def ids(column: DataFrame, group: str = "grp", order: str = "pos") -> DataFrame:
    """Unit numbers over the whole column, oldest group last, from the bottom up within a group."""
    return column.withColumn("unit_id", F.row_number().over(W.orderBy(F.col(group).desc(), F.col(order))) - 1)


def classify(value: Column, column: list[tuple[int, str, float, float]], unknown: int = -1) -> tuple[Column, Column]:
    """Number and name of the unit whose open interval holds the value; `column` has (id, name, low, high)."""
    number = case_of(value, [(lo, hi, i) for i, _, lo, hi in column], unknown)
    return number, case_of(value, [(lo, hi, name) for _, name, lo, hi in column])


#: Units that a column read on the driver may have; a field's values lie in tens of them.
MOST_UNITS = 10_000


def small(column: DataFrame, group: int | None = None) -> list[tuple[int, str, float, float]]:
    """The rows for `classify`, read on the driver: a column has one row per unit, and one of more than MOST_UNITS raises."""
    rows = ids(extents(column))
    rows = rows if group is None else rows.where(F.col("grp") == group)
    units = rows.orderBy("unit_id").limit(MOST_UNITS + 1).collect()
    if len(units) > MOST_UNITS:
        raise ValueError(f"a stratigraphic column of more than {MOST_UNITS} units: join its extents by band_join")
    return [(r.unit_id, r.unit, r.vmin, r.vmax) for r in units]
