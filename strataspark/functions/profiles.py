"""Scalar profiles: fault displacement along its frame, fold rotation angles, intrusion extents."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def smooth_peak(x: Column) -> Column:
    return F.when(F.abs(x) <= 1.0, x * x * x * x - 2.0 * x * x + 1.0).otherwise(0.0)


@dataclass
class Cubic:
    """A cubic through values and gradients, by least squares; constant beyond its limits."""

    values: list[tuple[float, float]] = field(default_factory=list)
    gradients: list[tuple[float, float]] = field(default_factory=list)
    limits: tuple[float, float] = (-math.inf, math.inf)
    bounds: tuple[float, float] = (-math.inf, math.inf)

    def weights(self) -> list[float]:
        if len(self.values) + len(self.gradients) < 3:
            raise ValueError("a cubic needs three constraints")
        rows = [[x**3, x**2, x, 1.0] for x, _ in self.values] + [[3 * x**2, 2 * x, 1.0, 0.0] for x, _ in self.gradients]
        got = np.linalg.lstsq(np.array(rows), np.array([y for _, y in self.values + self.gradients]), rcond=None)[0]
        return [round(float(w), 12) + 0.0 for w in got]

    def __call__(self, x: Column) -> Column:
        a, b, c, d = self.weights()
        if math.isfinite(self.limits[0]):
            x = F.greatest(x, F.lit(self.limits[0]))
        if math.isfinite(self.limits[1]):
            x = F.least(x, F.lit(self.limits[1]))
        out = ((F.lit(a) * x + b) * x + c) * x + d
        if math.isfinite(self.bounds[0]):
            out = F.greatest(out, F.lit(self.bounds[0]))
        return F.least(out, F.lit(self.bounds[1])) if math.isfinite(self.bounds[1]) else out


HANGING_WALL = Cubic([(0.0, 1.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)], (0.0, 1.0))
FOOTWALL = Cubic([(0.0, -1.0), (-1.0, 0.0)], [(0.0, 0.0), (-1.0, 0.0)], (-1.0, 0.0))


def composite(x: Column, positive: Cubic = HANGING_WALL, negative: Cubic = FOOTWALL) -> Column:
    """One profile on either side of the fault, 0 on it."""
    return F.when(x > 0, positive(x)).when(x < 0, negative(x)).otherwise(F.when(x.isNotNull(), 0.0))


def fault_displacement(gx: Column, gy: Column, gz: Column, three_d: bool = False) -> Column:
    """Half the product of the profiles along the fault frame's coordinates."""
    along = smooth_peak(gy) if three_d else F.lit(1.0)
    return F.lit(0.5) * composite(gx) * along * smooth_peak(gz)


def fourier(x: Column, c0: float, c1: float, c2: float, wavelength: float) -> Column:
    turn = x * F.lit(2.0 * math.pi / wavelength)
    return F.lit(c0) + F.lit(c1) * F.cos(turn) + F.lit(c2) * F.sin(turn)


def trigonometric(s: Column, origin: float, wavelength: float, low: float, high: float) -> Column:
    """Tangent of the limb rotation; low and high are inflection point angles in radians."""
    turn = (s - F.lit(origin)) * F.lit(2.0 * math.pi / wavelength)
    return F.lit(math.tan((high - low) / 2.0)) * F.sin(turn) + F.lit(math.tan((high + low) / 2.0))


def limb_rotation(tangent: Column) -> Column:
    return F.degrees(F.atan(tangent))


def ellipse(p: Column, min_p: Column, max_p: Column, min_s: Column, max_s: Column) -> tuple[Column, Column]:
    """Lateral extent on both sides, 0 outside the ellipse's range."""
    a, b = (max_p - min_p) / 2.0, (max_s - min_s) / 2.0
    u = (p - (min_p + a)) / a
    s = F.when((p > min_p) & (p < max_p), b * F.sqrt(F.greatest(F.lit(1.0) - u * u, F.lit(0.0)))).otherwise(0.0)
    return s, -s


#: By how much the base of an intrusion's cone is wider than its observed range.
CONE_MARGIN = 1.5


def oblique_cone(p: Column, s: Column, p_range: tuple[float, float], s_range: tuple[float, float], vertex: tuple[float, float, float]) -> tuple[Column, Column]:
    """The two heights at which the vertical through (p, s) meets an oblique double cone.

    The base is an ellipse at height 0 over the ranges, widened by CONE_MARGIN; `vertex` is (p, s, height).
    The line from the vertex to a point at height z meets the base plane at vertex + (point - vertex) / m
    with m = 1 - z / height. That this place is on the ellipse is a quadratic equation in m.
    """
    (low_p, high_p), (low_s, high_s) = p_range, s_range
    axis_p, axis_s = CONE_MARGIN * (high_p - low_p) / 2.0, CONE_MARGIN * (high_s - low_s) / 2.0
    top_p, top_s, height = vertex
    # in units of the half axes: the vertex from the centre, and the point from the vertex
    away = ((top_p - CONE_MARGIN * (low_p + high_p) / 2.0) / axis_p, (top_s - CONE_MARGIN * (low_s + high_s) / 2.0) / axis_s)
    to = ((p - F.lit(top_p)) / axis_p, (s - F.lit(top_s)) / axis_s)
    outside = away[0] ** 2 + away[1] ** 2 - 1.0
    slant = to[0] * away[0] + to[1] * away[1]
    spread = F.sqrt(F.greatest(slant * slant - (to[0] * to[0] + to[1] * to[1]) * outside, F.lit(0.0)))
    return tuple(height * (1.0 - (sign * spread - slant) / outside) for sign in (1.0, -1.0))


# Mean and deviation of exponent and factor of thickness against length.
SCALING = {
    "plutons": (0.81, 0.12, 1.08, 1.38),
    "laccoliths": (0.92, 0.11, 0.12, 0.02),
    "major_mafic_sills": (0.85, 0.1, 0.01, 0.02),
    "mesoscale_mafic_sills": (0.49, 0.13, 0.47, 0.33),
    "minor_mafic_sills": (0.91, 0.25, 0.27, 0.04),
}


def scaled_thickness(length: Column, kind: str) -> Column:
    """Thickness by the mean scaling of an intrusion type."""
    exponent, _, factor, _ = SCALING[kind]
    return F.lit(factor) * F.pow(length, F.lit(exponent))
