"""The constraint table: one row per observation, NULL where it says nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import angles

_DOUBLES = "X Y Z val interface nx ny nz gx gy gz tx ty tz l u pair_id polarity w".split()
SCHEMA = T.StructType([T.StructField("feature_name", T.StringType()), T.StructField("coord", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in _DOUBLES]])
#: Family to the columns that must be there.
FAMILIES = {"value": ["val"], "gradient": ["gx", "gy", "gz"], "normal": ["nx", "ny", "nz"], "tangent": ["tx", "ty", "tz"], "interface": ["interface"], "inequality": ["l", "u"], "pair": ["pair_id"]}


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinities."""
    x = F.col(c).cast("double") if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def prepare(df: DataFrame) -> DataFrame:
    """The canonical table: missing columns as NULL, weights and polarity filled in, strike and dip turned into gradients."""
    if "type" in df.columns and "feature_name" not in df.columns:
        df = df.withColumnRenamed("type", "feature_name")
    have = set(df.columns)
    pick = lambda c: finite(c) if c in have else F.lit(None).cast("double")
    sign = F.coalesce(pick("polarity"), F.lit(1.0))
    sign = F.when(sign == 0, -1.0).otherwise(sign)
    turned = {}
    if {"strike", "dip"} <= have:
        for c, x in zip(("gx", "gy", "gz"), angles.strike_dip_normal("strike", "dip"), strict=True):
            turned[c] = F.coalesce(pick(c), x * sign)
    out = {c: turned.get(c, pick(c)) for c in _DOUBLES}
    out["w"], out["polarity"] = F.coalesce(pick("w"), F.lit(1.0)), sign
    name = F.col("feature_name").cast("string") if "feature_name" in have else F.lit(None).cast("string")
    coord = F.coalesce(F.col("coord").cast("int"), F.lit(0)) if "coord" in have else F.lit(0)
    extra = [c for c in df.columns if c not in out and c not in ("feature_name", "coord", "strike", "dip")]
    return df.select(*extra, name.alias("feature_name"), coord.alias("coord"), *[out[c].alias(c) for c in _DOUBLES])


def of_family(df: DataFrame, family: str) -> DataFrame:
    """The rows that constrain by the family, without rows that lack a place."""
    test = F.lit(True)
    for c in ["X", "Y", "Z", *FAMILIES[family]]:
        test = test & F.col(c).isNotNull()
    return df.where(test)


def drop_invalid(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    test = F.lit(True)
    for c in columns:
        test = test & finite(c).isNotNull()
    return df.where(test)


def fill_weights(df: DataFrame, column: str = "w") -> DataFrame:
    return df.withColumn(column, F.coalesce(finite(column), F.lit(1.0)))


def diagnostics(df: DataFrame, inside: Column) -> DataFrame:
    """Per family: rows, rows with weight, weight range and mean, rows outside the model. One pass."""
    tests = []
    for family, columns in FAMILIES.items():
        has = F.lit(True)
        for c in columns:
            has = has & F.col(c).isNotNull()
        tests.append(F.when(has, F.lit(family)))
    rows = df.select("*", inside.alias("__in"), F.explode(F.array_compact(F.array(*tests))).alias("family"))
    return rows.groupBy("family").agg(F.count("*").alias("n_rows"), F.count_if(F.col("w") > 0).alias("n_active"), F.min("w").alias("w_min"), F.avg("w").alias("w_mean"), F.max("w").alias("w_max"), F.count_if(~F.col("__in")).alias("n_outside"))


def validate_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows, not numeric, not whole and repeated ids, in one pass."""
    number = F.expr(f"try_cast(`{column}` AS double)")
    return df.agg(F.count("*").alias("n_rows"), F.count_if(number.isNull()).alias("n_not_numeric"), F.count_if(number != F.floor(number)).alias("n_not_whole"), (F.count(column) - F.count_distinct(column)).alias("n_repeated"))


def validate_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: nulls and blanks."""
    counts = []
    for c in columns:
        counts += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}_blank")]
    return df.agg(*counts)


def validate_range(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: values outside the closed limits."""
    return df.agg(*[F.count_if(~F.col(c).between(lo, hi)).alias(f"{c}_outside") for c, (lo, hi) in limits.items()])


def text_flag(text: str | Column, needle: str) -> Column:
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))


def clean_name(name: str | Column) -> Column:
    """Characters from space to slash, and the question mark's range, become underscores."""
    return F.regexp_replace(name, "[ -/?]", "_")


def ignore(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows that contain none of the codes."""
    out = F.lit(False)
    for code in codes:
        out = out | text_flag(column, code)
    return df.where(~out)


# Compass points as degrees.
COMPASS = {"north_east": 45.0, "south_east": 135.0, "south_west": 225.0, "north_west": 315.0, "north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}


def compass_degrees(text: Column) -> Column:
    out = F.lit(None).cast("double")
    for point, angle in reversed(COMPASS.items()):
        out = F.when(F.lower(text).contains(point), F.lit(angle)).otherwise(out)
    return out
