"""Queries that solve for scalar fields, checked by identities in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tidy
from .functions.grid import Grid
from .operators import interpolate, structures, surface
from .sources.views import view

GRID = Grid((0.0, 0.0, 0.0), (20, 20, 20), (2.75, 2.75, 2.75))


def layers(spark: SparkSession) -> DataFrame:
    """Two horizontal layers of 10 x 10 points with their height as value."""
    n = F.col("id")
    z = F.when(n < 100, 2.0).otherwise(3.0) * 10.0
    return spark.range(200).select((n % 10 * 5.0 + 2.0).alias("X"), (F.floor(n % 100 / 10) * 5.0 + 2.0).alias("Y"), z.alias("Z"), z.alias("val"), F.lit("strati").alias("feature_name"))


def _foliation(spark: SparkSession) -> interpolate.Field:
    return interpolate.fields(interpolate.solve_features(layers(spark), GRID), GRID)["strati"]


class _Value:
    def __init__(self, field: interpolate.Field):
        self.field = field

    def __call__(self, xyz):  # noqa: ANN001, ANN204
        g = self.field.gradient(xyz)
        return {"value": self.field.value(xyz), "gz": g[:, 2]}


def fdi_foliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value and the slope of a foliation through two layers, at every observation."""
    got = interpolate.evaluate(view(spark, sf_dir, "obs_points"), _Value(_foliation(spark)), ["value", "gz"], "pid")
    return got.select("pid", tidy(F.col("value"), 3).alias("value"), tidy(F.col("gz"), 3).alias("gz"))


def faulted_foliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same foliation seen through a vertical fault at X = 25 that slips along Z."""
    fault = structures.Fault(structures.Plane((25, 0, 0), (1, 0, 0), 20.0), structures.Plane((0, 0, 25), (0, 0, 1), 30.0), structures.Plane((0, 25, 0), (0, 1, 0), 30.0), structures.Constant((0, 0, 1)), 8.0)
    kernel = structures.Faulted(_foliation(spark).value, [fault])
    got = interpolate.evaluate(view(spark, sf_dir, "obs_points"), kernel, ["value", "shift"], "pid")
    return got.select("pid", tidy(F.col("value"), 3).alias("value"), tidy(F.col("shift"), 3).alias("shift"))


def folded_foliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = structures.Folded(structures.Plane((0, 0, 0), (1, 0, 0)), structures.Plane((0, 0, 0), (0, 0, 1)), 0.8, 20.0)
    got = interpolate.evaluate(view(spark, sf_dir, "obs_points"), kernel, ["value", "limb"], "pid")
    return got.select("pid", tidy(F.col("value")).alias("value"), tidy(F.col("limb")).alias("limb"))


def isosurface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles and area of the foliation's surface at 25."""
    got = surface.isosurface(spark, _foliation(spark), 25.0)
    return got.agg(F.count("*").alias("n_triangles"), F.round(F.sum("area"), 1).alias("area"), F.round(F.min("z1"), 2).alias("low"), F.round(F.max("z1"), 2).alias("high"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (fdi_foliation, faulted_foliation, folded_foliation, isosurface)}


#: What the fold's query says in SQL.
FOLD_SQL = "SELECT pid, round(Z - 0.8*sin(2*pi()*X/20)*20/(2*pi()), 6)+0.0 AS value, round(degrees(atan(0.8*cos(2*pi()*X/20))), 6)+0.0 AS limb FROM obs_points"
