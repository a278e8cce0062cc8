"""Topology of a map: faults that meet, faults in units, units that share a boundary. Only rows of one cell or line meet."""

from __future__ import annotations

from math import isfinite, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines

#: Ends of a segment table.
ENDS = ("ax", "ay", "bx", "by_")


def _cells(df: DataFrame, low: tuple[Column, Column], high: tuple[Column, Column], cell: float) -> DataFrame:
    """One row for each cell that the box of a row touches."""
    at = lambda c: F.floor(c / cell)
    return df.withColumn("cx", F.explode(F.sequence(at(low[0]), at(high[0])))).withColumn("cy", F.explode(F.sequence(at(low[1]), at(high[1]))))


def _box(df: DataFrame, more: float = 0.0) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by_"))
    return tuple(F.least(p, q) - more for p, q in zip(a, b, strict=True)), tuple(F.greatest(p, q) + more for p, q in zip(a, b, strict=True))


def near_faults(segments: DataFrame, reach: float, key: str = "id", cell: float | None = None) -> DataFrame:
    """(fault1, fault2) with fault1 > fault2 for faults within `reach` of each other, once each.

    The widened box of one side and the box of the other are dealt to cells as wide as the geometric mean
    of the two boxes, at which the fewest rows meet; a pair that meets in several cells is kept in the
    first, where both boxes begin, so nothing must be made distinct but faults of several segments. Only
    pairs whose boxes touch get a distance. Ends are doubles from the start: decimals take many times as long.
    """
    segments = segments.select(key, *[F.col(c).cast("double").alias(c) for c in ENDS])
    (lx, ly), (hx, hy) = _box(segments, reach)
    (mx, my), (nx, ny) = _box(segments)
    known = segments.agg(F.count(key).alias("rows"), F.count_distinct(key).alias("faults"), F.avg(F.greatest(nx - mx, ny - my)).alias("size")).first()
    if cell is None:
        size = known.size if known.size is not None and isfinite(known.size) else 0.0
        cell = max(sqrt(size * (size + 2 * reach)), reach, 1.0)
    wide = _cells(segments.withColumns({"lx": lx, "ly": ly, "hx": hx, "hy": hy}), (lx, ly), (hx, hy), cell)
    thin = _cells(segments.withColumns({"mx": mx, "my": my, "nx": nx, "ny": ny}), (mx, my), (nx, ny), cell)
    wide = wide.select("cx", "cy", "lx", "ly", "hx", "hy", F.col(key).alias("fault1"), *[F.col(c).alias(f"p_{c}") for c in ENDS])
    thin = thin.select("cx", "cy", "mx", "my", "nx", "ny", F.col(key).alias("fault2"), *[F.col(c).alias(f"q_{c}") for c in ENDS])
    first = (F.col("cx") == F.floor(F.greatest("lx", "mx") / cell)) & (F.col("cy") == F.floor(F.greatest("ly", "my") / cell))
    touch = (F.col("mx") <= F.col("hx")) & (F.col("nx") >= F.col("lx")) & (F.col("my") <= F.col("hy")) & (F.col("ny") >= F.col("ly"))
    met = wide.join(thin.hint("merge"), ["cx", "cy"]).where((F.col("fault1") > F.col("fault2")) & touch & first)
    point = lambda s, e: (F.col(f"{s}_{e}x"), F.col(f"{s}_{e}y" if e == "a" else f"{s}_by_"))
    ends = point("p", "a"), point("p", "b"), point("q", "a"), point("q", "b")
    # as columns, whose common parts are computed once; explode keeps the optimiser from writing them out in the join's condition, a method too long to be compiled
    found = met.select("fault1", "fault2", lines.crossing(*ends).alias("cross"), lines.square_ends(*ends).alias("gap"))
    found = found.select("fault1", "fault2", F.explode(F.array(F.struct("cross", "gap"))).alias("f")).where(F.col("f.cross") | (F.col("f.gap") <= reach * reach)).select("fault1", "fault2")
    return found if known.rows == known.faults else found.distinct()


def fault_relations(segments: DataFrame, reach: float, key: str = "id") -> DataFrame:
    """The relations of faults that meet: a wide angle, so that no splay is made of them, and type T."""
    return near_faults(segments, reach, key).select("fault1", "fault2", F.lit(60).alias("angle"), F.lit("T").alias("type"))


def faults_in_units(segments: DataFrame, boxes: DataFrame, key: str = "id", unit: str = "unit", cell: float = 100.0) -> DataFrame:
    """(unit, fault) where a segment runs through a unit's rectangle or touches it."""
    low, high = _box(segments)
    s = _cells(segments, low, high, cell)
    b = _cells(boxes, (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")), cell)
    met = s.join(b.select(unit, "x0", "y0", "x1", "y1", "cx", "cy"), ["cx", "cy"])
    enters, leaves = lines.clipped((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by_")), (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))
    return met.where(enters <= leaves).select(unit, F.col(key).alias("fault")).distinct()


def boundaries(rings: DataFrame, unit: str = "unit") -> DataFrame:
    """The edges of closed rings (unit, ring: array of x, y), each as an interval on the line that it lies on.

    A line is its direction with a positive first part and its distance from the origin, both rounded,
    so edges that lie on one line share a key whatever their ends are.
    """
    edge = F.explode(F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring")), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by_"))))
    e = rings.select(unit, edge.alias("e")).where("e.by_ is not null").select(unit, "e.*")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    turn = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    size = F.hypot(dx, dy)
    e = e.where(size > 0).withColumns({"ux": F.round(turn * dx / size, 9) + 0.0, "uy": F.round(turn * dy / size, 9) + 0.0})
    e = e.withColumn("off", F.round(F.col("ux") * F.col("ay") - F.col("uy") * F.col("ax"), 6) + 0.0)
    along = lambda p: F.col("ux") * F.col(f"{p}x") + F.col("uy") * F.col("ay" if p == "a" else "by_")
    return e.withColumns({"t0": F.least(along("a"), along("b")), "t1": F.greatest(along("a"), along("b"))}).select(unit, "ux", "uy", "off", "t0", "t1")


def contacts(rings: DataFrame, unit: str = "unit") -> DataFrame:
    """unit1 < unit2 and the length of the boundary that they share, by edges on one line that overlap."""
    e = boundaries(rings, unit)
    other = e.select("ux", "uy", "off", F.col(unit).alias("unit2"), F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    shared = F.least("t1", "s1") - F.greatest("t0", "s0")
    met = e.withColumnRenamed(unit, "unit1").join(other, ["ux", "uy", "off"]).where((F.col("unit1") < F.col("unit2")) & (shared > 0))
    return met.groupBy("unit1", "unit2").agg(F.sum(shared).alias("length"))


def basal_contacts(pairs: DataFrame, column: DataFrame, unit: str = "unit", rank: str = "rank") -> DataFrame:
    """id, basal unit and type of each contact; ABNORMAL where units are missing between the two. Raises on units the column lacks."""
    order = F.broadcast(column.select(F.col(unit).alias("u_"), F.col(rank).alias("r_")))  # one row per unit of the column
    joined = pairs
    for side in ("unit1", "unit2"):
        joined = joined.join(order.withColumnsRenamed({"u_": side, "r_": f"{side}_rank"}), side, "left")
    low, high = F.col("unit1_rank"), F.col("unit2_rank")
    known = F.when(low.isNull() | high.isNull(), F.raise_error(F.concat(F.lit("not in the column: "), "unit1", F.lit(", "), "unit2"))).otherwise(F.least(low, high))
    basal = F.when(low <= high, F.col("unit1")).otherwise(F.col("unit2"))
    return joined.select("unit1", "unit2", known.cast("bigint").alias("id"), basal.alias("basal_unit"), F.when(F.abs(low - high) > 1, "ABNORMAL").otherwise("BASAL").alias("type"), "length")
