"""Polylines as ordered vertices: tangents, lengths, samples at equal spacing, neighbours along a section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(vertices: DataFrame, line: str = "trace_id", order: str = "seq") -> DataFrame:
    """Each pair of consecutive vertices with its length and its measure along the line."""
    w = W.partitionBy(line).orderBy(order)
    step = vertices.withColumn("X2", F.lead("X").over(w)).withColumn("Y2", F.lead("Y").over(w)).where("X2 is not null")
    step = step.withColumn("length", F.hypot(F.col("X2") - F.col("X"), F.col("Y2") - F.col("Y")))
    return step.withColumn("start", F.sum("length").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length"))


def tangents(vertices: DataFrame, line: str = "trace_id", order: str = "seq") -> DataFrame:
    """Unit direction of each segment; NULL for one without length."""
    s = segments(vertices, line, order)
    n = F.nullif("length", F.lit(0.0))
    return s.select(line, order, ((F.col("X2") - F.col("X")) / n).alias("tx"), ((F.col("Y2") - F.col("Y")) / n).alias("ty"))


def lengths(vertices: DataFrame, line: str = "trace_id", order: str = "seq") -> DataFrame:
    return segments(vertices, line, order).groupBy(line).agg(F.sum("length").alias("length"), F.count("*").alias("n_segments"))


def sample(vertices: DataFrame, spacing: float, line: str = "trace_id", order: str = "seq") -> DataFrame:
    """Points at 0, spacing, 2 * spacing ... along each line; the last of a line is left out, and a line no longer than the spacing has none."""
    s = segments(vertices, line, order)
    total = F.max(F.col("start") + F.col("length")).over(W.partitionBy(line))
    s = s.withColumn("__total", total).withColumn("__last", F.floor(F.col("__total") / spacing)).where((F.col("length") > 0) & (F.col("__total") > spacing))
    first, last = F.ceil(F.col("start") / spacing), F.ceil((F.col("start") + F.col("length")) / spacing) - 1
    last = F.least(last, F.col("__last") - 1)
    points = s.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * spacing - F.col("start")) / F.col("length")
    return points.select(line, F.col("k").cast("bigint").alias("k"), (F.col("X") + t * (F.col("X2") - F.col("X"))).alias("X"), (F.col("Y") + t * (F.col("Y2") - F.col("Y"))).alias("Y"))


def decimate(points: DataFrame, every: int, by: str, order: str) -> DataFrame:
    """Every n-th point of each group, beginning with the first."""
    return points.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(order))).where((F.col("__n") - 1) % every == 0).drop("__n")


def between_neighbours(pieces: DataFrame, section: str, order: str, unit: str) -> DataFrame:
    """Pieces of a section with a piece of another unit on either side, those two differing as well."""
    w = W.partitionBy(section).orderBy(order)
    n = pieces.withColumn("before", F.lag(unit).over(w)).withColumn("after", F.lead(unit).over(w))
    u = F.col(unit)
    return n.where((F.col("before") != u) & (F.col("after") != u) & (F.col("before") != F.col("after")))


def strike(vertices: DataFrame, line: str = "trace_id", order: str = "seq") -> DataFrame:
    """Azimuth of each segment, 0 to 360."""
    s = segments(vertices, line, order)
    return s.select(line, order, F.pmod(F.degrees(F.atan2(F.col("X2") - F.col("X"), F.col("Y2") - F.col("Y"))) + 360.0, F.lit(360.0)).alias("azimuth"))
