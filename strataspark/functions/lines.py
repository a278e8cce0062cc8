"""Segments in the plane as column expressions: distances, crossings and clipping. A point is a pair of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def square_to_segment(p: Point, a: Point, b: Point) -> Column:
    """The square of the distance from a point to a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    along = F.try_divide((p[0] - a[0]) * dx + (p[1] - a[1]) * dy, size)
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    x, y = a[0] + t * dx - p[0], a[1] + t * dy - p[1]
    return x * x + y * y


def side(p: Point, a: Point, b: Point) -> Column:
    """Positive where a point lies to the left of a segment."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def crossing(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether two segments cross inside both."""
    return (side(a, c, d) * side(b, c, d) < 0) & (side(c, a, b) * side(d, a, b) < 0)


def square_ends(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The square of the least distance of an end of two segments from the other one: their distance, unless they cross."""
    return F.least(square_to_segment(a, c, d), square_to_segment(b, c, d), square_to_segment(c, a, b), square_to_segment(d, a, b))


def square_distance(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The square of the distance of two segments."""
    return F.when(crossing(a, b, c, d), F.lit(0.0)).otherwise(square_ends(a, b, c, d))


def clipped(a: Point, b: Point, low: tuple[Column, Column], high: tuple[Column, Column]) -> tuple[Column, Column]:
    """The shares of a segment at which it enters and leaves a rectangle; it misses where the first isn't below the second."""
    begin, end = F.lit(0.0), F.lit(1.0)
    for axis in (0, 1):
        d = b[axis] - a[axis]
        near, far = (low[axis] - a[axis]) / F.nullif(d, F.lit(0.0)), (high[axis] - a[axis]) / F.nullif(d, F.lit(0.0))
        out = (a[axis] < low[axis]) | (a[axis] > high[axis])
        begin = F.greatest(begin, F.when(d != 0, F.least(near, far)).otherwise(F.when(out, F.lit(2.0)).otherwise(0.0)))
        end = F.least(end, F.when(d != 0, F.greatest(near, far)).otherwise(1.0))
    return begin, end


def across(p: Point, azimuth: Column, distance: Column | float) -> tuple[Point, Point]:
    """The ends of a line through a point at right angles to an azimuth: left, then right."""
    along = F.radians(F.lit(90.0) - azimuth)
    dx, dy = -F.sin(along) * distance, F.cos(along) * distance
    return (p[0] - dx, p[1] - dy), (p[0] + dx, p[1] + dy)
