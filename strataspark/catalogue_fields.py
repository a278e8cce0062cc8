"""Queries that solve for fields whose exact answer SQL can state: a linear function, by each family of constraints and each solver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import register
from .functions import tidy
from .functions.grid import Grid
from .operators import interpolate, system

GRID = Grid((0.0, 0.0, 0.0), (8, 8, 8), (7.0, 7.0, 7.0))
SLOPE = (2.0, 0.0, 0.2)
EXACT = "2*X + Z/5 + 3"
INSIDE = "X <= 56 AND Y <= 56 AND Z <= 56"


def samples(p: DataFrame) -> DataFrame:
    """One constraint for each (X, Z), of which there are a few hundred at any size: the mean of Y, and the exact value."""
    some = p.where(INSIDE).groupBy("X", "Z").agg(F.avg("Y").alias("Y"))
    return some.withColumns({"level": 2 * F.col("X") + F.col("Z") / 5 + 3, "feature_name": F.lit("plane"), "w": F.lit(1.0), "rare": F.abs(F.hash("X", "Z")) % 40 == 0})


def solved(rows: DataFrame, fit: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The node values of the one feature, found in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"values": [fit(pdf.sort_values(["X", "Z"])).tolist()]})

    return np.array(rows.groupBy("feature_name").applyInPandas(one, "values array<double>").first()[0])


class _Value:
    def __init__(self, field: system.SupportField):
        self.field = field

    def __call__(self, xyz: np.ndarray) -> dict[str, np.ndarray]:
        return {"value": self.field.value(xyz), "gx": self.field.gradient(xyz)[:, 0]}


def linear(p: DataFrame, columns: dict[str, Column], kind: str = "FDI", digits: int = 2, **options: object) -> DataFrame:
    """The field of the given constraints at every observation inside the grid."""
    chosen = system.Options(**options)
    values = solved(samples(p).withColumns(columns), lambda pdf: system.build(kind, GRID, pdf, chosen).values)
    field = system.SupportField(system.SUPPORTS[kind](GRID), values)
    got = interpolate.evaluate(p.where(INSIDE), _Value(field), ["value", "gx"], "pid")
    return got.select("pid", tidy("value", digits).alias("value"), tidy("gx", digits).alias("gx"))


_SQL = f"SELECT pid, round({EXACT}, 2)+0.0 AS value, 2.0::DOUBLE AS gx FROM obs_points WHERE {INSIDE}"


def _level() -> Column:
    return F.col("level")


def _few() -> Column:
    """The values of a few places, which fix what other families leave open."""
    return F.when(F.col("rare"), _level())


@register("obs_points", _SQL)
def field_from_values(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _level()})


@register("obs_points", _SQL)
def field_from_normals(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _few(), "nx": F.lit(SLOPE[0]), "ny": F.lit(SLOPE[1]), "nz": F.lit(SLOPE[2])})


@register("obs_points", _SQL)
def field_from_gradients(p: DataFrame) -> DataFrame:
    """Directions alone; the size comes from a few values."""
    return linear(p, {"val": _few(), "gx": F.lit(20.0), "gy": F.lit(0.0), "gz": F.lit(2.0)})


@register("obs_points", _SQL)
def field_from_tangents(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _few(), "tx": F.when(F.col("X") % 2 == 0, 0.0).otherwise(1.0), "ty": F.when(F.col("X") % 2 == 0, 1.0).otherwise(0.0), "tz": F.when(F.col("X") % 2 == 0, 0.0).otherwise(-10.0)})


@register("obs_points", _SQL)
def field_from_interfaces(p: DataFrame) -> DataFrame:
    """Places of equal value, which isn't given, and a few values."""
    return linear(p, {"val": _few(), "interface": _level()})


@register("obs_points", _SQL)
def field_within_bounds(p: DataFrame) -> DataFrame:
    """A few values, and bounds that hold the exact field at every place."""
    return linear(p, {"val": _few(), "l": _level(), "u": _level() + 1e-4}, digits=2)


@register("obs_points", _SQL)
def field_from_pairs(p: DataFrame) -> DataFrame:
    """A few values, and places that must lie above others."""
    return linear(p, {"val": _few(), "pair_id": F.when(F.col("rare"), F.floor(_level() / 20))})


@register("obs_points", _SQL)
def field_by_lsmr(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _level()}, solver="lsmr")


def _dense(s: system.System) -> np.ndarray:
    """A solver of one's own: dense least squares."""
    rows = sum(len(b.nodes) for b in s.blocks)
    whole, at = np.zeros((rows, s.size)), 0
    for b in s.blocks:
        np.add.at(whole, (at + np.arange(len(b.nodes))[:, None], b.nodes), b.coefs)
        at += len(b.nodes)
    return np.linalg.lstsq(whole, np.concatenate([b.target for b in s.blocks]), rcond=None)[0]


@register("obs_points", _SQL)
def field_by_callable(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _level()}, solver=_dense)


@register("obs_points", _SQL)
def field_with_directional_smoothness(p: DataFrame) -> DataFrame:
    """Smooth along one direction more than others, and without curvature at the borders."""
    return linear(p, {"val": _level()}, directional=((1.0, 1.0, 0.0), 0.5), borders=0.2, smooth=system.regularisation({"dxx": 0.1, "dyy": 0.2, "dzz": 0.1, "dxz": 0.05}))


@register("obs_points", _SQL)
def field_of_constant_norm(p: DataFrame) -> DataFrame:
    """Directions, one reference value and a slope of one size everywhere."""
    size = float(np.linalg.norm(SLOPE))
    return linear(p, {"val": F.when(F.col("rare"), _level()), "gx": F.lit(2.0), "gy": F.lit(0.0), "gz": F.lit(0.2)}, norm=size)


@register("obs_points", _SQL)
def tetra_field_from_values(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _level()}, kind="PLI")


@register("obs_points", _SQL)
def tetra_field_from_normals(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _few(), "nx": F.lit(SLOPE[0]), "ny": F.lit(SLOPE[1]), "nz": F.lit(SLOPE[2])}, kind="PLI")


@register("obs_points", _SQL)
def tetra_field_from_interfaces(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _few(), "interface": _level(), "tx": F.lit(0.0), "ty": F.lit(1.0), "tz": F.lit(0.0)}, kind="PLI")


@register("obs_points", _SQL)
def tetra_field_of_constant_norm(p: DataFrame) -> DataFrame:
    return linear(p, {"val": _few(), "gx": F.lit(2.0), "gy": F.lit(0.0), "gz": F.lit(0.2)}, kind="PLI", norm=float(np.linalg.norm(SLOPE)))


def _custom(p: DataFrame, change: Callable[[system.System, system.Support, pd.DataFrame], None], columns: dict[str, Column], kind: str = "FDI") -> DataFrame:
    """As `linear`, with rows that other than the constraint table add to the system."""

    def fit(pdf: pd.DataFrame) -> np.ndarray:
        support = system.SUPPORTS[kind](GRID)
        s = system.assemble(support, pdf, system.Options())
        change(s, support, pdf)
        return s.solve()

    field = system.SupportField(system.SUPPORTS[kind](GRID), solved(samples(p).withColumns(columns), fit))
    got = interpolate.evaluate(p.where(INSIDE), _Value(field), ["value", "gx"], "pid")
    return got.select("pid", tidy("value", 2).alias("value"), tidy("gx", 2).alias("gx"))


def _places(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["X", "Y", "Z"]].to_numpy(float)


@register("obs_points", _SQL)
def field_with_fixed_nodes(p: DataFrame) -> DataFrame:
    """Two faces of the grid have given values."""

    def change(s: system.System, support: system.Support, pdf: pd.DataFrame) -> None:
        at = support.nodes_at()
        s.fixed = {int(i): float(2 * at[i, 0] + at[i, 2] / 5 + 3) for i in np.flatnonzero((at[:, 0] == 0) | (at[:, 0] == 56))}

    return _custom(p, change, {"val": _few()})


@register("obs_points", _SQL)
def field_at_right_angles(p: DataFrame) -> DataFrame:
    """At right angles to two other fields' slopes: along Y, and across its own slope; a few values."""

    def change(s: system.System, support: system.Support, pdf: pd.DataFrame) -> None:
        at = _places(pdf)
        for v in ((0.0, 1.0, 0.0), (-0.2, 0.0, 2.0)):
            system.orthogonal(s, support, at, np.tile(v, (len(at), 1)))

    return _custom(p, change, {"val": _few()})


@register("obs_points", _SQL)
def fold_constrained_field(p: DataFrame) -> DataFrame:
    """Flat along a fold's direction and axis, with a given slope across: here those of the exact plane."""

    def change(s: system.System, support: system.Support, pdf: pd.DataFrame) -> None:
        at = _places(pdf)
        rows = lambda v: np.tile(np.array(v) / np.linalg.norm(v), (len(at), 1))
        system.add_fold(s, support, at, rows((0.2, 0.0, -2.0)), rows((0.0, -1.0, 0.0)), system.FoldTerms(size=-float(np.linalg.norm(SLOPE))))

    return _custom(p, change, {"val": _few()})


@register("obs_points", _SQL)
def tetra_fold_constrained_field(p: DataFrame) -> DataFrame:
    def change(s: system.System, support: system.Support, pdf: pd.DataFrame) -> None:
        at = _places(pdf)
        rows = lambda v: np.tile(np.array(v) / np.linalg.norm(v), (len(at), 1))
        system.add_fold(s, support, at, rows((0.2, 0.0, -2.0)), rows((0.0, -1.0, 0.0)), system.FoldTerms(size=-float(np.linalg.norm(SLOPE))))

    return _custom(p, change, {"val": _few()}, kind="PLI")


@register("obs_points", "SELECT * FROM (VALUES ('value', true), ('normal', true)) t(family, small)")
def constraint_residuals(p: DataFrame) -> DataFrame:
    """Per family whether every row of the solved system meets its target."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        support = system.GridSupport(GRID)
        s = system.assemble(support, pdf.sort_values(["X", "Z"]), system.Options())
        missed = s.residuals(s.solve())
        return pd.DataFrame([(n, bool(np.abs(missed[n]).max() < 1e-4)) for n in ("value", "normal")], columns=["family", "small"])

    rows = samples(p).withColumns({"val": _level(), "nx": F.lit(2.0), "ny": F.lit(0.0), "nz": F.lit(0.2)})
    return rows.groupBy("feature_name").applyInPandas(one, "family string, small boolean")


class _Radial:
    def __init__(self, field: system.RadialField, names: tuple[str, ...]):
        self.field, self.names = field, names

    def __call__(self, xyz: np.ndarray) -> dict[str, np.ndarray]:
        got = np.concatenate([self.field.value(xyz[i : i + 2000]) for i in range(0, len(xyz), 2000)])
        return {n: got[:, i] for i, n in enumerate(self.names)}


@register("obs_points", f"SELECT pid, round({EXACT}, 2)+0.0 AS value, round(X/10 + 0.0001, 3)+0.0 AS nx, 0.5::DOUBLE AS ny FROM obs_points WHERE {INSIDE}")
def radial_field(p: DataFrame) -> DataFrame:
    """Values and two parts of normals between scattered places, by kernels of the cubed distance and a linear function."""
    rows = samples(p).where(F.abs(F.hash("X", "Z")) % 3 == 0).withColumn("nx", F.col("X") / 10)
    pdf = rows.select("X", "Y", "Z", "level", "nx").toPandas().sort_values(["X", "Z"])  # a few hundred places at any size
    field = system.RadialField(_places(pdf), np.stack([pdf["level"].to_numpy(float), pdf["nx"].to_numpy(float), np.full(len(pdf), 0.5)], 1))
    got = interpolate.evaluate(p.where(INSIDE), _Radial(field, ("value", "nx", "ny")), ["value", "nx", "ny"], "pid")
    return got.select("pid", tidy("value", 2).alias("value"), tidy(F.col("nx") + 0.0001, 3).alias("nx"), tidy("ny", 3).alias("ny"))
