"""Local frames: a point and an angle in map view, fitted to points or given."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .angles import Vector


def fitted(points: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    """One row: the centre (tx, ty) and the angle that turns the main axis of the points onto X."""
    sums = points.agg(F.avg(x).alias("tx"), F.avg(y).alias("ty"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    axis = 0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))
    return sums.select("tx", "ty", (-F.acos(F.abs(F.cos(axis)))).alias("angle"))


def turned(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


@dataclass(frozen=True)
class LocalFrame:
    """World to local: less the origin, then turned about the vertical by `degrees`."""

    origin: tuple[float, float, float]
    degrees: float = 0.0

    def vectors_to_local(self, v: Vector, sign: float = 1.0) -> Vector:
        c, s = math.cos(math.radians(self.degrees)), sign * math.sin(math.radians(self.degrees))
        return F.lit(c) * v[0] - F.lit(s) * v[1], F.lit(s) * v[0] + F.lit(c) * v[1], v[2]

    def vectors_to_world(self, v: Vector) -> Vector:
        return self.vectors_to_local(v, -1.0)

    def to_local(self, p: Vector) -> Vector:
        return self.vectors_to_local(tuple(a - F.lit(o) for a, o in zip(p, self.origin, strict=True)))

    def to_world(self, p: Vector) -> Vector:
        return tuple(a + F.lit(o) for a, o in zip(self.vectors_to_world(p), self.origin, strict=True))
