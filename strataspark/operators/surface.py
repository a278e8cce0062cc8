"""Isosurfaces by tetrahedra: each cell is cut into six, and each of those gives none, one or two triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .interpolate import Field

#: The six tetrahedra about the diagonal of a cell; corners are numbered dx + 2 dy + 4 dz.
TETRAHEDRA = tuple((0, 1 << a, (1 << a) | (1 << b), 7) for a in range(3) for b in range(3) if a != b)


def triangles(field: Field, cells: np.ndarray, iso: float) -> np.ndarray:
    """Corner points (n, 3, 3) of the surface's triangles in the given cells."""
    nx, ny, _ = field.grid.nodes
    cx, cy, _ = field.grid.cells
    ijk = np.stack([cells % cx, cells // cx % cy, cells // (cx * cy)], axis=1)
    shift = np.array([[n & 1, n >> 1 & 1, n >> 2 & 1] for n in range(8)])
    corner = ijk[:, None, :] + shift[None]
    value = field.values[corner[:, :, 0] + nx * (corner[:, :, 1] + ny * corner[:, :, 2])] - iso
    place = np.array(field.grid.origin) + corner * np.array(field.grid.step)
    out = []
    for tet in TETRAHEDRA:
        v, p = value[:, tet], place[:, tet]
        order = np.argsort(v, axis=1, kind="stable")  # lowest corners first
        v, p = np.take_along_axis(v, order, 1), np.take_along_axis(p, order[:, :, None], 1)
        below = (v < 0).sum(axis=1)

        def cut(rows: np.ndarray, a: int, b: int, v: np.ndarray = v, p: np.ndarray = p) -> np.ndarray:
            t = v[rows, a] / (v[rows, a] - v[rows, b])
            return p[rows, a] + t[:, None] * (p[rows, b] - p[rows, a])

        for n, faces in ((1, [((0, 1), (0, 2), (0, 3))]), (3, [((0, 3), (1, 3), (2, 3))]), (2, [((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2))])):
            rows = np.flatnonzero(below == n)
            if len(rows):
                out += [np.stack([cut(rows, a, b) for a, b in face], axis=1) for face in faces]
    return np.concatenate(out) if out else np.empty((0, 3, 3))


def isosurface(spark: SparkSession, field: Field, iso: float) -> DataFrame:
    """cell-wise triangles: x1..z3, area; cells are dealt over tasks."""
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = triangles(shared.value, batch.column("id").to_numpy(), iso)
            area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) / 2.0
            yield pa.RecordBatch.from_arrays([*[pa.array(t[:, i, j]) for i in range(3) for j in range(3)], pa.array(area)], [*[f"{c}{i}" for i in (1, 2, 3) for c in "xyz"], "area"])

    names = ", ".join(f"{c}{i} double" for i in (1, 2, 3) for c in "xyz")
    return spark.range(int(np.prod(field.grid.cells))).mapInArrow(run, f"{names}, area double").where(F.col("area") > 0)
