"""Grouped statistics: thickness, faults, variograms, misfits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def thickness_summary(samples: DataFrame, units: DataFrame, unit: str = "unit", value: str = "thickness", population: bool = False) -> DataFrame:
    """Median, mean and deviation per unit of `units`; -1 where it has no sample."""
    spread = F.stddev_pop(value) if population else F.stddev_samp(value)
    got = samples.where(F.col(value) > 0).groupBy(unit).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), spread.alias("std"), F.count("*").alias("n"))
    out = units.select(unit).distinct().join(got, unit, "left")
    return out.select(unit, *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("median", "mean", "std")], F.coalesce("n", F.lit(0)).alias("n"))


def true_thickness(apparent: Column, dip: Column) -> Column:
    return apparent * F.sin(F.radians(dip))


def to_unit_above(summary: DataFrame, units: DataFrame, order: str, unit: str = "unit") -> DataFrame:
    """Statistics measured at a unit's base are written to the unit after it in the order."""
    following = units.select(unit, F.lead(unit).over(W.orderBy(order)).alias("above"))
    return summary.join(following, unit).where("above is not null").drop(unit).withColumnRenamed("above", unit)


def few_known(summary: DataFrame, mean: str = "mean") -> DataFrame:
    """Share of units without a thickness, and whether that is three quarters or more."""
    share = F.avg((F.col(mean) == -1).cast("double"))
    return summary.agg(share.alias("share"), (share >= 0.75).alias("warn"))


def fault_summary(points: DataFrame, name: str, least: int = 2) -> DataFrame:
    """Mean place of each fault with at least `least` observations."""
    got = points.groupBy(name).agg(F.count("*").alias("n_points"), *[F.avg(c).alias(c) for c in points.columns if c in ("X", "Y", "Z")])
    return got.where(F.col("n_points") >= least)


def fault_radii(vertices: DataFrame, name: str, x: str = "X", y: str = "Y") -> DataFrame:
    """Length of each trace's box diagonal and the three radii of its displacement."""
    got = vertices.groupBy(name).agg(F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("length"))
    return got.select(name, "length", F.col("length").alias("horizontal_radius"), (F.col("length") / 2.0).alias("vertical_radius"), (F.col("length") / 4.0).alias("minor_radius"))


def semivariogram(samples: DataFrame, position: str, value: str, step: float, lags: int, key: str) -> DataFrame:
    """Per lag i * step, i < lags: pairs whose distance lies within half a step of it, and their mean squared difference.

    Samples at one place become one row of their number, mean and sum of squares about it, from which the
    squared differences of two places' samples follow: a * b * (difference of means)^2 + b * Qa + a * Qb.
    Places meet by slices of the largest distance, so the join grows with the places in range, whatever
    the number of samples at each. A null place or value is in no pair.
    """
    reach = step * (lags - 0.5)
    known = samples.where(F.col(position).isNotNull() & F.col(value).isNotNull())
    places = known.groupBy(F.col(position).alias("x")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("q"))
    a, b = (places.select(*[F.col(c).alias(f"{c}{side}") for c in "xnmq"]) for side in "ab")
    a = a.withColumn("s", F.floor(F.col("xa") / reach))
    b = b.withColumn("s", F.explode(F.array(*[F.floor(F.col("xb") / reach) + d for d in (-1, 0, 1)])))
    d = F.abs(F.col("xa") - F.col("xb"))
    apart = F.col("ma") - F.col("mb")
    squares = F.col("na") * F.col("nb") * apart * apart + F.col("nb") * F.col("qa") + F.col("na") * F.col("qb")
    pairs = a.join(b, "s").where(d < reach).select(d.alias("d"), (F.col("na") * F.col("nb")).alias("n"), squares.alias("q"))
    lag = F.floor(F.col("d") / step + 0.5)
    half = F.col("d") == (lag - 0.5) * step  # the bins are open: a distance on a border is in none
    got = pairs.where(~half).groupBy(lag.cast("bigint").alias("lag")).agg(F.sum("n").alias("n_pairs"), F.sum("q").alias("q")).where(F.col("lag") < lags)
    return got.select("lag", "n_pairs", (F.col("q") / F.col("n_pairs")).alias("gamma"))


def turning_points(series: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """The first, the last and every local high or low along x."""
    w = W.partitionBy(*by).orderBy(x)
    before, after = F.col(y) - F.lag(y).over(w), F.lead(y).over(w) - F.col(y)
    marked = series.withColumn("__b", before).withColumn("__a", after)
    keep = F.col("__b").isNull() | F.col("__a").isNull() | (F.signum("__b") * F.signum("__a") < 0)
    return marked.where(keep).drop("__b", "__a")


def normalised(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(value - min) / (max - min), overall or by group."""
    if not by:
        edge = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))  # one row
        both = df.join(F.broadcast(edge))
    else:
        both = df.join(df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")), list(by))
    return both.withColumn("normalised", (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))).drop("__lo", "__hi")


def lags(samples: DataFrame, position: str, most: int = 200) -> DataFrame:
    """One row: step and number of steps of a variogram.

    The nearest other position of a sample is one of the two next distinct positions, so distinct
    positions are sorted once; no pairs are made.
    """
    distinct = samples.groupBy(F.col(position).alias("x")).agg(F.count("*").alias("n"))
    order = W.orderBy("x")
    gap = F.least(F.col("x") - F.lag("x").over(order), F.lead("x").over(order) - F.col("x"))
    sums = distinct.withColumn("gap", gap).agg(F.sum(F.col("n") * F.col("gap")).alias("g"), F.sum("n").alias("n"), (F.max("x") - F.min("x")).alias("range"))
    steps = sums.select((F.col("g") / F.col("n") * 4.0).alias("step"), "range").withColumn("steps", F.ceil(F.col("range") / F.col("step")))
    return steps.select(F.when(F.col("steps") > most, F.col("step") * F.col("steps") / most).otherwise(F.col("step")).alias("step"), F.least("steps", F.lit(most)).cast("bigint").alias("steps"))


def wavelength(series: DataFrame, x: str, y: str, least: float = 10.0, share: float = 0.7) -> DataFrame:
    """One row: the first turning point above `least` whose neighbours among the turning points are below `share` of it, else twice the range."""
    order = W.orderBy(x)  # a series has as many rows as a variogram has lags
    turn = series.withColumns({"a_": F.lag(y).over(order), "c_": F.lead(y).over(order)})
    v, a, c = F.col(y), F.col("a_"), F.col("c_")
    turn = turn.where(((v > a) & (v > c)) | ((v < a) & (v < c)))
    peaks = turn.withColumns({"a_": F.lag(y).over(order), "c_": F.lead(y).over(order)})
    found = peaks.where((v > least) & (a < v * share) & (c < v * share)).agg(F.min(x).alias("first"))
    whole = series.agg((2 * (F.max(x) - F.min(x))).alias("twice"))
    return found.crossJoin(whole).select((F.coalesce("first", "twice") + F.lit(0.0)).alias("wavelength"))
