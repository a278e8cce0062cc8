"""Regions and unconformity masks. A mask is never NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(mask: Column) -> Column:
    return F.coalesce(mask, F.lit(False))


def signed_distance(x: Column, y: Column, point: tuple[float, float], direction: tuple[float, float]) -> Column:
    """Horizontal distance from a point along a direction."""
    return (x - F.lit(point[0])) * F.lit(direction[0]) + (y - F.lit(point[1])) * F.lit(direction[1])


def positive(value: Column, distance: Column) -> Column:
    """Above the surface; where the value is unknown, by the side of the point."""
    return sure(F.when(value.isNull(), distance > 0).otherwise(value > 0))


def negative(value: Column, distance: Column) -> Column:
    return sure(F.when(value.isNull(), distance < 0).otherwise(value < 0))


def beyond(value: Column, threshold: float, above: bool) -> Column:
    return sure(value > threshold if above else value < threshold)


def all_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a & b, masks, F.lit(True))


def masked(value: Column, *masks: Column) -> Column:
    """NULL outside the regions."""
    return F.when(all_of(*masks), value)


def erode(older: Column, unconformity: Column, at: float = 0.0) -> Column:
    """An older feature is kept below an unconformity only."""
    return masked(older, beyond(unconformity, at, above=False))


def onlap(younger: Column, surface: Column, at: float = 0.0) -> Column:
    """A younger feature is kept above the surface that it laps on."""
    return masked(younger, sure(surface >= at))
