"""Faults and folds as kernels over arrays of points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions.profiles import FOOTWALL, HANGING_WALL, Cubic


def _cubic(profile: Cubic, x: np.ndarray) -> np.ndarray:
    x = np.clip(x, *profile.limits)
    a, b, c, d = profile.weights()
    return ((a * x + b) * x + c) * x + d


def _peak(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) <= 1.0, x**4 - 2.0 * x**2 + 1.0, 0.0)


@dataclass
class Fault:
    """A fault by its frame: across (the surface is 0), along the slip, and along the strike, each scaled to -1..1."""

    across: Callable[[np.ndarray], np.ndarray]
    slip: Callable[[np.ndarray], np.ndarray]
    strike: Callable[[np.ndarray], np.ndarray]
    direction: Callable[[np.ndarray], np.ndarray]
    displacement: float
    steps: int = 10

    def offset(self, xyz: np.ndarray) -> np.ndarray:
        """Signed displacement; 0 on the fault, where it is unknown and beyond its volume."""
        gx, gy, gz = self.across(xyz), self.slip(xyz), self.strike(xyz)
        profile = np.where(gx > 0, _cubic(HANGING_WALL, gx), np.where(gx < 0, _cubic(FOOTWALL, gx), 0.0))
        return np.nan_to_num(0.5 * self.displacement * profile * np.where(np.abs(gy) <= 1, 1.0, 0.0) * _peak(gz))

    def restore(self, xyz: np.ndarray) -> np.ndarray:
        """Points moved back along the slip in small steps, their displacement taken anew at each."""
        out = xyz.astype(float).copy()
        moving = self.offset(out) != 0.0
        for _ in range(self.steps if moving.any() else 0):
            d = self.offset(out[moving])
            v = self.direction(out[moving])
            size = np.linalg.norm(v, axis=1, keepdims=True)
            out[moving] += np.where(size > 0, v / np.where(size > 0, size, 1.0), 0.0) * (d / self.steps)[:, None]
        return out


@dataclass
class Faulted:
    """A field seen through faults, the youngest first."""

    field: Callable[[np.ndarray], np.ndarray]
    faults: list[Fault]

    def __call__(self, xyz: np.ndarray) -> dict[str, np.ndarray]:
        moved = xyz
        for fault in self.faults:
            moved = fault.restore(moved)
        return {"value": self.field(moved), "shift": np.linalg.norm(moved - xyz, axis=1)}


@dataclass
class Plane:
    """A linear coordinate (n . (x - o)) / scale, which pickles."""

    origin: tuple[float, float, float]
    normal: tuple[float, float, float]
    scale: float = 1.0

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        return (xyz - np.array(self.origin)) @ np.array(self.normal) / self.scale


@dataclass
class Constant:
    vector: tuple[float, float, float]

    def __call__(self, xyz: np.ndarray) -> np.ndarray:
        return np.broadcast_to(np.array(self.vector), xyz.shape)


@dataclass
class Folded:
    """A folded foliation: limb rotation by a Fourier profile of the fold frame's first coordinate.

    The layers' height along the second coordinate is the integral of the tangent of the limb's angle.
    """

    first: Plane
    second: Plane
    amplitude: float
    wavelength: float

    def __call__(self, xyz: np.ndarray) -> dict[str, np.ndarray]:
        turn = 2.0 * np.pi * self.first(xyz) / self.wavelength
        tangent = self.amplitude * np.cos(turn)
        lift = self.amplitude * np.sin(turn) * self.wavelength / (2.0 * np.pi)
        return {"value": self.second(xyz) - lift, "limb": np.degrees(np.arctan(tangent))}
