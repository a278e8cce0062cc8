"""Regular grids as arithmetic: nodes and cells are numbers, never rows that must be joined."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("X", "Y", "Z")


@dataclass(frozen=True)
class Grid:
    """Origin, cells along each axis and their size; node number i + nx * (j + ny * k)."""

    origin: tuple[float, float, float]
    cells: tuple[int, int, int]
    step: tuple[float, float, float]

    @classmethod
    def over(cls, origin: tuple[float, ...], maximum: tuple[float, ...], elements: float = 1e4) -> Grid:
        """Cells of nearly one size, about `elements` of them."""
        size = [b - a for a, b in zip(origin, maximum, strict=True)]
        edge = (math.prod(size) / elements) ** (1.0 / 3.0)
        cells = tuple(max(1, math.ceil(s / edge)) for s in size)
        return cls(tuple(origin), cells, tuple(s / n for s, n in zip(size, cells, strict=True)))

    @property
    def nodes(self) -> tuple[int, int, int]:
        return tuple(n + 1 for n in self.cells)

    @property
    def maximum(self) -> tuple[float, float, float]:
        return tuple(o + n * s for o, n, s in zip(self.origin, self.cells, self.step, strict=True))

    def node_frame(self, spark: SparkSession) -> DataFrame:
        """node, X, Y, Z of every node, made on the executors."""
        return self._frame(spark, self.nodes, 0.0)

    def cell_frame(self, spark: SparkSession) -> DataFrame:
        """node, X, Y, Z of every cell centre."""
        return self._frame(spark, self.cells, 0.5)

    def _frame(self, spark: SparkSession, size: tuple[int, int, int], shift: float) -> DataFrame:
        n = F.col("id")
        place = (n % size[0], F.floor(n / size[0]) % size[1], F.floor(n / (size[0] * size[1])))
        return spark.range(math.prod(size)).select(n.alias("node"), *[(F.lit(o) + (i.cast("double") + F.lit(shift)) * F.lit(s)).alias(a) for a, o, i, s in zip(AXES, self.origin, place, self.step, strict=True)])

    def inside(self, names: tuple[str, ...] = AXES) -> Column:
        out = F.lit(True)
        for a, lo, hi in zip(names, self.origin, self.maximum, strict=True):
            out = out & F.col(a).between(lo, hi)
        return F.coalesce(out, F.lit(False))

    def cell(self, names: tuple[str, ...] = AXES) -> list[Column]:
        """Cell numbers along each axis; the upper face belongs to the last cell."""
        return [F.least(F.floor((F.col(a) - F.lit(o)) / F.lit(s)), F.lit(n - 1)).cast("bigint") for a, o, s, n in zip(names, self.origin, self.step, self.cells, strict=True)]

    def local(self, names: tuple[str, ...] = AXES) -> list[Column]:
        """Place within the cell, 0 to 1."""
        return [(F.col(a) - F.lit(o)) / F.lit(s) - i for a, o, s, i in zip(names, self.origin, self.step, self.cell(names), strict=True)]

    def corner(self, cell: list[Column], dx: int, dy: int, dz: int) -> Column:
        nx, ny, _ = self.nodes
        return cell[0] + dx + (cell[1] + dy) * nx + (cell[2] + dz) * (nx * ny)

    def weights(self, local: list[Column]) -> dict[tuple[int, int, int], Column]:
        """The trilinear weight of each corner."""
        one = F.lit(1.0)
        side = lambda u, d: u if d else one - u
        return {(dx, dy, dz): side(local[0], dx) * side(local[1], dy) * side(local[2], dz) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)}

    def gradient_weights(self, local: list[Column]) -> dict[tuple[int, int, int], tuple[Column, Column, Column]]:
        """The weights of each corner in the gradient."""
        one = F.lit(1.0)
        side = lambda u, d: u if d else one - u
        out = {}
        for dz in (0, 1):
            for dy in (0, 1):
                for dx in (0, 1):
                    d = (dx, dy, dz)
                    grads = []
                    for axis in range(3):
                        w = F.lit((1.0 if d[axis] else -1.0) / self.step[axis])
                        for other in range(3):
                            if other != axis:
                                w = w * side(local[other], d[other])
                        grads.append(w)
                    out[d] = tuple(grads)
        return out

    def located(self, points: DataFrame) -> DataFrame:
        """Points with their cell (ci, cj, ck) and place in it (lu, lv, lt), each computed once; NULL outside."""
        inside = points.withColumns({c: F.when(self.inside(), x) for c, x in zip(("ci", "cj", "ck"), self.cell(), strict=True)})
        return inside.withColumns({c: (F.col(a) - F.lit(o)) / F.lit(s) - F.col(i) for c, a, o, s, i in zip(("lu", "lv", "lt"), AXES, self.origin, self.step, ("ci", "cj", "ck"), strict=True)})

    def interpolate(self, node_value: Callable[[Column], Column]) -> Column:
        """Trilinear value at `located` points, for coefficients that are a function of the node number."""
        cell, (u, v, t) = [F.col(c) for c in ("ci", "cj", "ck")], [F.col(c) for c in ("lu", "lv", "lt")]
        at = lambda dx, dy, dz: node_value(self.corner(cell, dx, dy, dz))
        mid = lambda a, b, w: a + w * (b - a)
        return mid(*[mid(*[mid(at(0, dy, dz), at(1, dy, dz), u) for dy in (0, 1)], v) for dz in (0, 1)], t)

    def gradient(self, node_value: Callable[[Column], Column]) -> tuple[Column, Column, Column]:
        """Its slopes along X, Y and Z at `located` points."""
        cell, place = [F.col(c) for c in ("ci", "cj", "ck")], [F.col(c) for c in ("lu", "lv", "lt")]
        mid = lambda a, b, w: a + w * (b - a)
        out = []
        for axis in range(3):
            b, c = (x for x in range(3) if x != axis)

            def rise(x: int, y: int, axis: int = axis, b: int = b, c: int = c) -> Column:
                ends = []
                for e in (0, 1):
                    d = [0, 0, 0]
                    d[axis], d[b], d[c] = e, x, y
                    ends.append(node_value(self.corner(cell, *d)))
                return (ends[1] - ends[0]) / F.lit(self.step[axis])

            out.append(mid(*[mid(rise(0, y), rise(1, y), place[b]) for y in (0, 1)], place[c]))
        return tuple(out)
