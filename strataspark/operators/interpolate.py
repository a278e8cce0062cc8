"""Scalar fields by least squares on a regular grid: one small solve per feature, any number of evaluations.

A feature's constraints are few, so a feature is solved inside one task (`solve_features`): value,
gradient and normal rows by trilinear weights, smoothness by second differences as array slices, and
conjugate gradients on the normal equations. Coefficients go out as one array per feature, whose
size the grid bounds; evaluation is a pass over points without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid


@dataclass
class Field:
    """Node values over a grid."""

    grid: Grid
    values: np.ndarray

    def _cell(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = (xyz - np.array(self.grid.origin)) / np.array(self.grid.step)
        with np.errstate(invalid="ignore"):
            inside = ((u >= 0) & (u <= np.array(self.grid.cells))).all(axis=1)
        u = np.where(inside[:, None], u, 0.0)
        i = np.minimum(np.floor(u).astype(np.int64), np.array(self.grid.cells) - 1)
        return inside, i, u - i

    def rows(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which points are inside, and the nodes and weights of each point's corners."""
        inside, i, t = self._cell(xyz)
        nx, ny, _ = self.grid.nodes
        nodes, weights = [], []
        for dz in (0, 1):
            for dy in (0, 1):
                for dx in (0, 1):
                    nodes.append((i[:, 0] + dx) + nx * ((i[:, 1] + dy) + ny * (i[:, 2] + dz)))
                    weights.append(np.where(dx, t[:, 0], 1 - t[:, 0]) * np.where(dy, t[:, 1], 1 - t[:, 1]) * np.where(dz, t[:, 2], 1 - t[:, 2]))
        return inside, np.stack(nodes, 1), np.stack(weights, 1)

    def slopes(self, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `rows`, with three weights per corner: of the derivatives along X, Y and Z."""
        inside, nodes, _ = self.rows(xyz)
        _, _, t = self._cell(xyz)
        out = np.empty((len(xyz), 8, 3))
        n = 0
        for dz in (0, 1):
            for dy in (0, 1):
                for dx in (0, 1):
                    d = (dx, dy, dz)
                    side = [np.where(d[a], t[:, a], 1 - t[:, a]) for a in range(3)]
                    for a in range(3):
                        b, c = (a + 1) % 3, (a + 2) % 3
                        out[:, n, a] = (1.0 if d[a] else -1.0) / self.grid.step[a] * side[b] * side[c]
                    n += 1
        return inside, nodes, out

    def value(self, xyz: np.ndarray) -> np.ndarray:
        """NaN outside the grid."""
        inside, nodes, weights = self.rows(xyz)
        return np.where(inside, (self.values[nodes] * weights).sum(axis=1), np.nan)

    def gradient(self, xyz: np.ndarray) -> np.ndarray:
        inside, nodes, weights = self.slopes(xyz)
        return np.where(inside[:, None], np.einsum("nk,nka->na", self.values[nodes], weights), np.nan)


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, tol: float = 1e-8, most: int = 3000) -> np.ndarray:
    x, r = np.zeros_like(rhs), rhs.copy()
    p, rr = r.copy(), float(r @ r)
    stop = tol * tol * max(rr, 1e-300)
    for _ in range(most):
        if rr <= stop:
            break
        q = apply(p)
        a = rr / float(p @ q)
        x += a * p
        r -= a * q
        new = float(r @ r)
        p, rr = r + (new / rr) * p, new
    return x


def _smoothness(shape: tuple[int, int, int]) -> Callable[[np.ndarray], np.ndarray]:
    """The normal matrix of second differences along and across the axes, without a matrix."""

    def apply(c: np.ndarray) -> np.ndarray:
        v, out = c.reshape(shape), np.zeros(shape)
        for a in range(3):
            if shape[a] > 2:
                lo, mid, hi = (tuple(slice(s, shape[a] - 2 + s) if x == a else slice(None) for x in range(3)) for s in range(3))
                d = v[lo] - 2.0 * v[mid] + v[hi]
                out[lo] += d
                out[mid] -= 2.0 * d
                out[hi] += d
        for a, b in ((0, 1), (0, 2), (1, 2)):
            corner = {(i, j): tuple(slice(i, shape[x] - 1 + i) if x == a else slice(j, shape[x] - 1 + j) if x == b else slice(None) for x in range(3)) for i in (0, 1) for j in (0, 1)}
            d = v[corner[0, 0]] - v[corner[1, 0]] - v[corner[0, 1]] + v[corner[1, 1]]
            for (i, j), at in corner.items():
                out[at] += d if i == j else -d
        return out.reshape(-1)

    return apply


def solve(grid: Grid, data: pd.DataFrame, smooth: float = 0.1, tol: float = 1e-8) -> Field:
    """The field of one feature's constraints: val; nx, ny, nz (direction and size); gx, gy, gz (direction only); w."""
    field = Field(grid, np.zeros(int(np.prod(grid.nodes))))
    data = data.dropna(subset=["X", "Y", "Z"])
    xyz = data[["X", "Y", "Z"]].to_numpy(float)
    weight = data["w"].fillna(1.0).to_numpy(float) if "w" in data else np.ones(len(data))
    nodes, coefs, target = [], [], []

    def add(node: np.ndarray, coef: np.ndarray, rhs: np.ndarray, w: np.ndarray) -> None:
        size = np.maximum(np.linalg.norm(coef, axis=1), 1e-12)
        scale = w / size
        nodes.append(node)
        coefs.append(coef * scale[:, None])
        target.append(rhs * scale)

    def has(columns: list[str]) -> np.ndarray:
        return data[columns].notna().all(axis=1).to_numpy() if set(columns) <= set(data.columns) else np.zeros(len(data), bool)

    some = has(["val"])
    inside, node, coef = field.rows(xyz)
    some &= inside
    add(node[some], coef[some], data["val"].to_numpy(float)[some] if "val" in data else np.empty(0), weight[some])
    inside, node, coef = field.slopes(xyz)
    some = has(["nx", "ny", "nz"]) & inside
    if some.any():
        normal = data.loc[some, ["nx", "ny", "nz"]].to_numpy(float)
        for a in range(3):
            add(node[some], coef[some][:, :, a], normal[:, a], weight[some] / 3.0)
    some = has(["gx", "gy", "gz"]) & inside
    if some.any():  # the field is flat along two directions across the gradient
        g = data.loc[some, ["gx", "gy", "gz"]].to_numpy(float)
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)
        other = np.where(np.abs(g[:, [2]]) < 0.9, np.array([[0.0, 0.0, 1.0]]), np.array([[1.0, 0.0, 0.0]]))
        first = np.cross(g, other)
        first /= np.linalg.norm(first, axis=1, keepdims=True)
        for across in (first, np.cross(g, first)):
            add(node[some], np.einsum("nka,na->nk", coef[some], across), np.zeros(int(some.sum())), weight[some])
    node, coef, rhs = np.concatenate(nodes), np.concatenate(coefs), np.concatenate(target)
    size = len(field.values)
    flat = node.reshape(-1)
    rough = _smoothness(grid.nodes[::-1])

    def apply(c: np.ndarray) -> np.ndarray:
        r = (c[node] * coef).sum(axis=1)
        return np.bincount(flat, (coef * r[:, None]).reshape(-1), size) + smooth * smooth * rough(c)

    field.values = conjugate_gradients(apply, np.bincount(flat, (coef * rhs[:, None]).reshape(-1), size), tol)
    return field


def solve_features(constraints: DataFrame, grid: Grid, smooth: float = 0.1) -> DataFrame:
    """feature_name and coefficients: one task solves one feature."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature_name": [key[0]], "coefficients": [solve(grid, pdf, smooth).values.tolist()]})

    return constraints.groupBy("feature_name").applyInPandas(one, "feature_name string, coefficients array<double>")


def fields(solved: DataFrame, grid: Grid) -> dict[str, Field]:
    """The solved fields on the driver: as many numbers per feature as the grid has nodes."""
    return {r.feature_name: Field(grid, np.array(r.coefficients)) for r in solved.collect()}


def evaluate(points: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], key: str) -> DataFrame:
    """key and the kernel's columns at X, Y, Z; one pass, each point crosses to Python once. NaN becomes NULL."""
    shared = points.sparkSession.sparkContext.broadcast(kernel)  # holds fields, whose size the grid bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                xyz = np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(float) for a in ("X", "Y", "Z")], axis=1)
                got = shared.value(xyz)
                yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(np.asarray(got[n], float), from_pandas=True) for n in names]], [key, *names])

    kind = dict(points.dtypes)[key]
    chosen = points.select(key, *[F.col(a).cast("double").alias(a) for a in ("X", "Y", "Z")])
    return chosen.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))
