"""Golden numbers and identities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.functions import angles, profiles
from strataspark.functions.grid import Grid
from strataspark.modelling import GRID, layers
from strataspark.operators import constraints, interpolate, relations, statistics, structures, surface, traces
from strataspark.plans.bands import case_of, near_pairs


def one(spark, *columns):
    return [float(v) for v in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()]


@pytest.mark.parametrize(("strike", "dip", "expected"), [(0, 30, (0.5, 0, 0.866025)), (45, 60, (0.612372, -0.612372, 0.5)), (90, 90, (0, -1, 0))])
def test_strike_dip(spark, strike, dip, expected):
    assert one(spark, *angles.strike_dip_normal(F.lit(float(strike)), F.lit(float(dip)))) == pytest.approx(expected, abs=1e-5)


@pytest.mark.parametrize(("plunge", "azimuth", "expected"), [(0, 90, (1, 0, 0)), (90, 90, (0, 0, -1)), (0, 0, (0, 1, 0))])
def test_plunge(spark, plunge, azimuth, expected):
    assert one(spark, *angles.plunge_vector(F.lit(float(plunge)), F.lit(float(azimuth)))) == pytest.approx(expected, abs=1e-9)


def test_rotation_keeps_length_and_axis(spark):
    axis = (F.lit(0.6), F.lit(0.0), F.lit(0.8))
    v = angles.rotate((F.lit(1.0), F.lit(2.0), F.lit(3.0)), axis, F.lit(73.0))
    got = one(spark, angles.length(v), angles.dot(v, axis))
    assert got == pytest.approx([14**0.5, 3.0])


def test_profiles(spark):
    x = [F.lit(v) for v in (-2.0, -1.0, 0.0, 0.5, 1.0, 3.0)]
    assert one(spark, *[profiles.smooth_peak(v) for v in x]) == pytest.approx([0, 0, 1, 0.5625, 0, 0])
    assert one(spark, *[profiles.composite(v) for v in x]) == pytest.approx([0, 0, 0, 0.5, 0, 0])
    with pytest.raises(ValueError, match="three"):
        profiles.Cubic([(0.0, 1.0)]).weights()


def test_bands_are_open_and_null_is_unknown(spark):
    got = spark.createDataFrame([(0.0,), (5.0,), (7.0,), (None,)], "v double").select(case_of(F.col("v"), [(0.0, 5.0, 1), (5.0, None, 2)], -1).alias("u")).collect()
    assert [r.u for r in got] == [-1, -1, 2, -1]


def test_prepare_fills_what_is_missing(spark):
    got = constraints.prepare(spark.createDataFrame([("a", 0.0, 30.0, 0.0, float("nan"))], "feature_name string, strike double, dip double, polarity double, w double")).first()
    assert (got.w, got.polarity, got.coord, got.val) == (1.0, -1.0, 0, None)
    assert got.gx == pytest.approx(-0.5)


def test_linear_field_is_exact(spark):
    grid = Grid((0.0, 0.0, 0.0), (4, 5, 6), (1.0, 2.0, 0.5))
    ijk = np.array([(i, j, k) for k in range(7) for j in range(6) for i in range(5)], float)
    xyz = ijk * np.array(grid.step)
    field = interpolate.Field(grid, 2 * xyz[:, 0] - xyz[:, 1] + 3 * xyz[:, 2] + 1)
    p = np.random.default_rng(1).random((50, 3)) * np.array(grid.maximum)
    assert field.value(p) == pytest.approx(2 * p[:, 0] - p[:, 1] + 3 * p[:, 2] + 1)
    assert field.gradient(p) == pytest.approx(np.tile([2.0, -1.0, 3.0], (50, 1)))
    assert np.isnan(field.value(np.array([[-1.0, 0, 0], [np.nan, 0, 0]]))).all()
    assert interpolate._smoothness(grid.nodes[::-1])(field.values) == pytest.approx(np.zeros(len(field.values)), abs=1e-9)


def test_layers_are_reproduced(spark):
    field = interpolate.fields(interpolate.solve_features(layers(spark), GRID), GRID)["strati"]
    data = layers(spark).toPandas()
    assert field.value(data[["X", "Y", "Z"]].to_numpy()) == pytest.approx(data["val"].to_numpy(), abs=1e-3)
    area = surface.isosurface(spark, field, 26.0).agg(F.sum("area")).first()[0]
    assert area == pytest.approx(55.0 * 55.0, rel=1e-3)


def test_normals_fix_the_slope():
    grid = Grid((0.0, 0.0, 0.0), (6, 6, 6), (1.0, 1.0, 1.0))
    data = pd.DataFrame({"X": [3.0, 1.0], "Y": [3.0, 2.0], "Z": [3.0, 2.0], "val": [0.0, np.nan], "nx": [np.nan, 0.0], "ny": [np.nan, 0.0], "nz": [np.nan, 2.0]})
    field = interpolate.solve(grid, data, smooth=0.01)
    assert field.value(np.array([[3.0, 3.0, 4.0]])) == pytest.approx([2.0], abs=0.02)


def test_fault_moves_both_sides_apart_and_nothing_beyond():
    fault = structures.Fault(structures.Plane((5, 0, 0), (1, 0, 0), 5.0), structures.Plane((0, 0, 5), (0, 0, 1), 50.0), structures.Plane((0, 5, 0), (0, 1, 0), 5.0), structures.Constant((0, 0, 1)), 2.0)
    p = np.array([[5.5, 5, 5], [4.5, 5, 5], [5.0, 5, 5], [11.0, 5, 5], [5.5, 20, 5]])
    moved = fault.restore(p)
    assert moved[0, 2] > 5.5
    assert moved[1, 2] < 4.5
    assert moved[2:] == pytest.approx(p[2:])


def test_sampling_leaves_the_last_point_out(spark):
    line = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 3.0, 2.5), (2, 1, 0.0, 0.0), (2, 2, 1.0, 0.0)], "trace_id int, seq int, X double, Y double")
    got = [(r.X, r.Y) for r in traces.sample(line, 1.0).orderBy("trace_id", "k").collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (3.0, 1.0)]


def test_near_pairs_are_all_pairs_in_reach(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * 10 - 5)]
    a = spark.createDataFrame(pts, "i int, x double, y double")
    b = spark.createDataFrame(pts, "j int, u double, v double")
    got = {(r.i, r.j) for r in near_pairs(a, b, 1.5, ("x", "y"), ("u", "v")).collect()}
    assert got == {(i, j) for i, x, y in pts for j, u, v in pts if np.hypot(x - u, y - v) <= 1.5}


def test_orders():
    assert relations.peel([("c", "b"), ("b", "a"), ("a", "c")]) in (["a", "c", "b"], ["b", "a", "c"], ["c", "b", "a"])
    assert relations.tour({("a", "b"): 5.0, ("b", "c"): 4.0, ("a", "d"): 3.0}) in (["d", "a", "b", "c"], ["c", "b", "a", "d"])


def test_turning_points(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 0, 1, 1, 2])], "x int, y double")
    assert [r.x for r in statistics.turning_points(s.withColumn("g", F.lit(1)), "x", "y", "g").orderBy("x").collect()] == [0, 1, 2, 5]
