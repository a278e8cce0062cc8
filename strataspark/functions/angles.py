"""Orientations as vectors: strike and dip, dip direction, plunge, rotation. Vectors are triples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import clamp

Vector = tuple[Column, Column, Column]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sin(x: Column | str) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column | str) -> Column:
    return F.cos(F.radians(x))


def strike_dip_normal(strike: Column | str, dip: Column | str) -> Vector:
    return _sin(dip) * _cos(strike), -_sin(dip) * _sin(strike), _cos(dip)


def dip_direction_normal(direction: Column | str, dip: Column | str) -> Vector:
    return _sin(dip) * _sin(direction), _sin(dip) * _cos(direction), _cos(dip)


def plunge_vector(plunge: Column | str, azimuth: Column | str) -> Vector:
    return _sin(azimuth) * _cos(plunge), _cos(azimuth) * _cos(plunge), -_sin(plunge)


def strike_vector(strike: Column | str) -> Vector:
    return -_sin(strike), -_cos(strike), F.lit(0.0)


def dip_vector(strike: Column | str, dip: Column | str) -> Vector:
    """Down the dip."""
    return -_cos(strike) * _cos(dip), -_sin(strike) * _cos(dip), -_sin(dip)


def length(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def unit(v: Vector) -> Vector:
    """NULL for a vector without length."""
    n = F.nullif(length(v), F.lit(0.0))
    return v[0] / n, v[1] / n, v[2] / n


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def project_on_plane(v: Vector, normal: Vector) -> Vector:
    """The part of v across a unit normal."""
    d = dot(v, normal)
    return v[0] - d * normal[0], v[1] - d * normal[1], v[2] - d * normal[2]


def rotate(v: Vector, axis: Vector, angle: Column | str) -> Vector:
    """v turned about a unit axis."""
    c, s, d = _cos(angle), _sin(angle), dot(axis, v)
    w = cross(axis, v)
    return tuple(v[i] * c + w[i] * s + axis[i] * d * (F.lit(1.0) - c) for i in range(3))


def normal_strike(v: Vector) -> Column:
    return F.degrees(-F.atan2(v[1], v[0]))


def normal_dip(v: Vector) -> Column:
    return F.degrees(F.acos(clamp(v[2] / length(v), -1.0, 1.0)))


def normal_dip_direction(v: Vector) -> Column:
    return F.pmod(F.degrees(F.atan2(v[0], v[1])) + F.lit(360.0), F.lit(360.0))


def angle_between(a: Column | str, b: Column | str) -> Column:
    """The smaller angle between two directions."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def strike_symbol(strike: Column | str) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """Ends of the strike line and of the dip tick of a map symbol, about the origin."""
    return (_sin(strike), _cos(strike)), (_cos(strike), -_sin(strike))


def tetrahedron(x: Column, y: Column, z: Column, scale: float) -> Column:
    """Four points about a point, for a gradient from values."""
    a = 0.5773502691896258 * scale
    corners = ((a, a, a), (-a, -a, a), (-a, a, -a), (a, -a, -a))
    return F.array(*[F.struct((x + dx).alias("X"), (y + dy).alias("Y"), (z + dz).alias("Z")) for dx, dy, dz in corners])
