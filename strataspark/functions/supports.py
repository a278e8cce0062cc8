"""Tetrahedra, uneven axes and triangles as column expressions: no element is ever a row that must be joined."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid

Corner = tuple[int, int, int]
@dataclass(frozen=True)
class Tetrahedra:
    """Five tetrahedra for each cell of a grid: four at every other corner and one in the middle; odd cells are mirrored along X.

    The number of a tetrahedron is 5 * cell + its place.
    """

    grid: Grid

    def located(self, points: DataFrame) -> DataFrame:
        """Points with cell (ci, cj, ck), place in it, `tet` and its four weights b0 to b3; NULL outside the grid."""
        df = self.grid.located(points)
        odd = (F.col("ci") + F.col("cj") + F.col("ck")) % 2 == 1
        u = F.when(odd, 1 - F.col("lu")).otherwise(F.col("lu"))
        df = df.withColumns({"odd": odd, "u_": u})
        u, v, t = F.col("u_"), F.col("lv"), F.col("lt")
        # above the plane through three neighbours of a corner, the corner's tetrahedron holds the point
        outer = [1 - u - v - t, u + v - t - 1, u - v + t - 1, -u + v + t - 1]
        inner = [(1 + u - v - t) / 2, (1 - u + v - t) / 2, (1 - u - v + t) / 2, (u + v + t - 1) / 2]
        place = F.when(u.isNull(), None)
        for i, o in enumerate(outer):
            place = place.when(o >= 0, i)
        df = df.withColumn("place_", place.otherwise(4))
        weights = [
            (outer[0], u, v, t),
            (outer[1], 1 - u, 1 - v, t),
            (outer[2], 1 - u, v, 1 - t),
            (outer[3], u, 1 - v, 1 - t),
        ]
        at = F.col("place_")
        out = {}
        for k in range(4):
            c = F.when(at == 4, inner[k])
            for i, w in enumerate(weights):
                c = c.when(at == i, w[k])
            out[f"b{k}"] = c
        cx, cy, _ = self.grid.cells
        out["tet"] = (F.col("ci") + cx * (F.col("cj") + cy * F.col("ck"))) * 5 + at
        return df.withColumns(out).drop("u_")

    #: Corners of each place, in the order of the weights of `located`.
    CORNERS: tuple[tuple[Corner, ...], ...] = (
        ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)),
        ((1, 1, 0), (0, 1, 0), (1, 0, 0), (1, 1, 1)),
        ((1, 0, 1), (0, 0, 1), (1, 1, 1), (1, 0, 0)),
        ((0, 1, 1), (1, 1, 1), (0, 0, 1), (0, 1, 0)),
        ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)),
    )

    def node(self, k: int) -> Column:
        """The node of weight k at `located` points."""
        cell = [F.col(c) for c in ("ci", "cj", "ck")]
        out = None
        for i, corners in enumerate(self.CORNERS):
            dx, dy, dz = corners[k]
            x = F.when(F.col("odd"), F.lit(1 - dx)).otherwise(F.lit(dx))
            nx, ny, _ = self.grid.nodes
            node = cell[0] + x + (cell[1] + dy) * nx + (cell[2] + dz) * (nx * ny)
            out = F.when(F.col("place_") == i, node) if out is None else out.when(F.col("place_") == i, node)
        return out

    def valued(self, df: DataFrame, node_value: Callable[[Column], Column]) -> DataFrame:
        """`located` points with the values v0 to v3 of their tetrahedron's corners."""
        df = df.withColumns({f"n{k}_": self.node(k) for k in range(4)})
        return df.withColumns({f"v{k}": node_value(F.col(f"n{k}_")) for k in range(4)}).drop(*[f"n{k}_" for k in range(4)])

    @staticmethod
    def value() -> Column:
        """The linear value in the tetrahedron of each `valued` point."""
        return sum((F.col(f"b{k}") * F.col(f"v{k}") for k in range(1, 4)), F.col("b0") * F.col("v0"))

    def gradient(self) -> tuple[Column, Column, Column]:
        """The constant slopes of the tetrahedron of each `valued` point."""
        out = []
        for axis in range(3):
            c = None
            for i, corners in enumerate(self.CORNERS):
                total = sum((F.lit(s / self.grid.step[axis]) * F.col(f"v{k}") for k, s in enumerate(_slopes(corners)[axis])), F.lit(0.0))
                c = F.when(F.col("place_") == i, total) if c is None else c.when(F.col("place_") == i, total)
            out.append(F.when(F.col("odd"), -c).otherwise(c) if axis == 0 else c)
        return tuple(out)


def _slopes(corners: Sequence[Corner]) -> list[list[float]]:
    """Per axis what each corner's value adds to the slope, for a cell of size one."""
    edges = np.array(corners[1:], float) - np.array(corners[0], float)
    inverse = np.linalg.inv(edges)
    return [[-float(inverse[a].sum()), *map(float, inverse[a])] for a in range(3)]


@dataclass(frozen=True)
class UnevenAxis:
    """Nodes at any rising places; the cell of a point is found among them."""

    nodes: tuple[float, ...]

    def cell(self, x: Column) -> Column:
        """The number of the cell, NULL outside; the last node belongs to the last cell. Nodes halve by halves, as a search tree."""

        def search(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x < F.lit(self.nodes[mid]), search(lo, mid)).otherwise(search(mid, hi))

        return F.when(x.between(self.nodes[0], self.nodes[-1]), search(0, len(self.nodes) - 1))

    def node(self, cell: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in self.nodes]), (cell + 1).cast("int"))

    def local(self, x: Column) -> Column:
        at = self.cell(x)
        return (x - self.node(at)) / (self.node(at + 1) - self.node(at))

    def second_difference(self, i: int) -> tuple[float, float, float]:
        """Weights of the nodes i - 1, i and i + 1 in the second derivative at node i."""
        left, right = self.nodes[i] - self.nodes[i - 1], self.nodes[i + 1] - self.nodes[i]
        a, b = 2.0 / (left * (left + right)), 2.0 / (right * (left + right))
        return a, -(a + b), b


def triangle_weights(p: tuple[Column, Column], corners: Sequence[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """Weights of a triangle's corners at a point; all are nought or more inside."""
    (ax, ay), (bx, by), (cx, cy) = corners
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    b = ((p[0] - ax) * (cy - ay) - (cx - ax) * (p[1] - ay)) / area
    c = ((bx - ax) * (p[1] - ay) - (p[0] - ax) * (by - ay)) / area
    return 1 - b - c, b, c


def quadratic(weights: Sequence[Column]) -> list[Column]:
    """Shape functions of the corners and then of the edges' midpoints (pairs in order) of a triangle or tetrahedron."""
    corners = [w * (2 * w - 1) for w in weights]
    edges = [4 * weights[i] * weights[j] for i in range(len(weights)) for j in range(i + 1, len(weights))]
    return corners + edges
