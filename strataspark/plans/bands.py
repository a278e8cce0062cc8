"""Interval lookups and distance joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands up to which a lookup becomes one CASE; beyond, the bands are halved at a bound, so a row meets the log of their number.
CASE_BANDS = 64


def case_of(value: Column, bands: Sequence[tuple[float | None, float | None, object]], otherwise: object = None) -> Column:
    """The result of the open band (low, high) that holds the value; the last of several matches wins. None: no bound."""
    lows = sorted(low for low, _, _ in bands if low is not None)
    if len(bands) > CASE_BANDS and lows:
        middle = lows[len(lows) // 2]
        below = [b for b in bands if b[0] is None or b[0] < middle]
        above = [b for b in bands if b[1] is None or b[1] > middle]
        if max(len(below), len(above)) < len(bands):
            return F.when(value <= F.lit(middle), case_of(value, below, otherwise)).otherwise(case_of(value, above, otherwise))
    out = F.lit(otherwise)
    for low, high, result in bands:
        hit = F.lit(True)
        if low is not None:
            hit = hit & (value > F.lit(low))
        if high is not None:
            hit = hit & (value < F.lit(high))
        out = F.when(F.coalesce(hit & value.isNotNull(), F.lit(False)), F.lit(result)).otherwise(out)
    return out


def band_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with each open band that holds their value, by an equi-join on slices of `width` and a filter."""
    cut = bands.withColumn("__slice", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    both = points.withColumn("__slice", F.floor(F.col(value) / width)).join(cut, "__slice")
    return both.where((F.col(value) > F.col(low)) & (F.col(value) < F.col(high))).drop("__slice")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, ...], right_xy: tuple[str, ...]) -> DataFrame:
    """Rows of both sides within `radius`, with their distance: each right row goes to its own cell and the cells around it."""
    cells = [f"__c{i}" for i in range(len(left_xy))]
    a = left.select("*", *[F.floor(F.col(x) / radius).alias(c) for x, c in zip(left_xy, cells, strict=True)])
    b = right
    for x, c in zip(right_xy, cells, strict=True):
        here = F.floor(F.col(x) / radius)
        b = b.withColumn(c, F.explode(F.sequence(here - 1, here + 1)))
    square = sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(left_xy, right_xy, strict=True)), F.lit(0.0))
    return a.join(b, cells).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius).drop(*cells)
