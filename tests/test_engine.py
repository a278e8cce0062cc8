"""Solvers, supports, topology, files and configurations against closed forms and brute force."""

from __future__ import annotations

import decimal
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark import catalogue
from strataspark.functions import profiles
from strataspark.functions.grid import Grid
from strataspark.operators import network, system, topology
from strataspark.sinks import text
from strataspark.sources import config, files

GRID = Grid((0.0, 0.0, 0.0), (4, 4, 4), (2.5, 2.5, 2.5))


def random_points(n=60, seed=3):
    return np.random.default_rng(seed).uniform(0.1, 9.9, (n, 3))


def table(xyz, **columns):
    return pd.DataFrame(xyz, columns=["X", "Y", "Z"]).assign(**columns)


@pytest.mark.parametrize("kind", sorted(system.SUPPORTS))
def test_supports_reproduce_linear_functions(kind):
    support = system.SUPPORTS[kind](GRID)
    at = system.GridSupport(GRID).nodes_at()
    f = lambda p: 2 * p[:, 0] - 3 * p[:, 1] + 0.5 * p[:, 2] + 1
    field = system.SupportField(support, f(at))
    p = random_points()
    assert np.allclose(field.value(p), f(p)) and np.allclose(field.gradient(p), [2, -3, 0.5])
    assert np.isnan(field.value(np.array([[11.0, 0, 0]]))).all()
    _, _, w = support.rows(p)
    assert w.min() > -1e-9 and np.allclose(w.sum(1), 1)


def test_every_inner_face_has_two_tetrahedra():
    one, two, face = system.TetSupport(GRID).faces()
    assert len(face) == (5 * 64 * 4 - 6 * 16 * 2) // 2 and (one != two).all()


def test_solvers_agree_with_dense_least_squares():
    p = random_points()
    data = table(p, val=np.sin(p[:, 0]) + p[:, 2], w=1.0)
    s = system.assemble(system.GridSupport(GRID), data, system.Options(borders=0.3, directional=((1.0, 2.0, 0.5), 0.2)))
    rows = sum(len(b.nodes) for b in s.blocks)
    dense, at = np.zeros((rows, s.size)), 0
    for b in s.blocks:
        np.add.at(dense, (at + np.arange(len(b.nodes))[:, None], b.nodes), b.coefs)
        at += len(b.nodes)
    want = np.linalg.lstsq(dense, np.concatenate([b.target for b in s.blocks]), rcond=None)[0]
    for solver in ("cg", "lsmr"):
        assert np.allclose(s.solve(solver, tol=1e-13), want, atol=1e-5)
    missed = s.residuals(want)
    assert sum(len(m) for m in missed.values()) == rows


def test_bounds_hold_and_bind():
    p = random_points(80)
    f = p[:, 0]
    data = table(p, val=np.where(np.arange(80) < 40, f, np.nan), l=np.where(np.arange(80) >= 40, f + 0.5, np.nan), u=np.where(np.arange(80) >= 40, f + 9.0, np.nan))
    field = system.build("FDI", GRID, data, system.Options(smooth=system.regularisation(0.02)))
    over = field.value(p[40:]) - f[40:]
    assert over.min() > 0.5 - 0.01 and over.min() < 0.55
    pairs = table(p, val=np.where(np.arange(80) < 4, 1.0, np.nan), pair_id=np.floor(p[:, 1] / 5))
    value = system.build("FDI", GRID, pairs).value(p)
    assert value[p[:, 1] >= 5].min() >= value[p[:, 1] < 5].max() - 0.01


def test_fixed_nodes_stay():
    support = system.GridSupport(GRID)
    s = system.assemble(support, table(random_points(), val=1.0), system.Options())
    s.fixed = {0: 7.0, 10: -2.0}
    got = s.solve()
    assert (got[0], got[10]) == (7.0, -2.0)


def test_unknown_interpolators_and_regularisation_raise():
    with pytest.raises(ValueError, match="no interpolator"):
        system.build("XYZ", GRID, table(random_points(), val=1.0))
    with pytest.raises(ValueError, match="no such"):
        system.regularisation({"dab": 1.0})


def test_radial_field_meets_its_points():
    p = random_points(50)
    values = np.stack([np.sin(p[:, 0]), p[:, 1]], 1)
    assert np.allclose(system.RadialField(p, values).value(p), values, atol=1e-6)


def test_cone_heights_lie_on_the_cone(spark):
    """A point at the height that is found, seen from the vertex, falls on the base ellipse."""
    p_range, s_range, vertex = (5.0, 45.0), (5.0, 45.0), (25.0, 20.0, 60.0)
    df = spark.createDataFrame([(float(x), float(y)) for x in range(0, 50, 7) for y in range(0, 50, 9)], "p double, s double")
    up, down = profiles.oblique_cone(F.col("p"), F.col("s"), p_range, s_range, vertex)
    for r in df.select("p", "s", up.alias("a"), down.alias("b")).collect():
        for z in (r.a, r.b):
            k = vertex[2] / (vertex[2] - z)
            x, y = vertex[0] + (r.p - vertex[0]) * k, vertex[1] + (r.s - vertex[1]) * k
            assert ((x - 37.5) / 30) ** 2 + ((y - 37.5) / 30) ** 2 == pytest.approx(1.0, abs=1e-6)


def test_faults_near_each_other_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.uniform(0, 100, 2))) for i in range(80)]
    rows = [(i, x, y, x + float(rng.uniform(-20, 20)), y + float(rng.uniform(-20, 20))) for i, x, y in rows]
    got = {(r.fault1, r.fault2) for r in topology.near_faults(spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by_ double"), 3.0).collect()}
    t = np.linspace(0, 1, 400)[:, None]
    lines = {r[0]: np.array(r[1:3]) + t * (np.array(r[3:]) - np.array(r[1:3])) for r in rows}
    for a, b in itertools.combinations(lines, 2):
        gap = np.sqrt(((lines[a][:, None] - lines[b][None]) ** 2).sum(2)).min()
        assert ((b, a) in got) == (gap <= 3.0) or abs(gap - 3.0) < 0.1


def test_the_distance_of_faults_is_code_that_the_jvm_compiles(spark, sf_dir):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["fault_fault_relations"](spark, sf_dir)._jdf.queryExecution()
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sizes and max(map(int, sizes)) < 8000  # longer methods are interpreted


def test_faults_of_several_decimal_segments_meet_once(spark):
    rows = [(1, "0.5", "0.0", "9.5", "0.0"), (1, "9.5", "0.0", "20.0", "0.0"), (2, "0.5", "0.0", "9.5", "0.0"), (3, "30.0", "4.0", "30.0", "4.0"), (3, "9.5", "3.0", "9.5", "9.0"), (4, "10.0", "-3.5", "12.0", "-3.5")]
    segments = spark.createDataFrame([(i, *map(decimal.Decimal, r)) for i, *r in rows], "id long, ax decimal(22,1), ay decimal(22,1), bx decimal(22,1), by_ decimal(22,1)")
    assert sorted(map(tuple, topology.near_faults(segments, 3.0).collect())) == [(2, 1), (3, 1), (3, 2)]


def test_two_crossing_faults_and_two_squares(spark):
    faults = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 10.0, 10.0, 0.0), (3, 90.0, 0.0, 99.0, 0.0)], "id long, ax double, ay double, bx double, by_ double")
    assert [tuple(r) for r in topology.fault_relations(faults, 1.0).collect()] == [(2, 1, 60, "T")]
    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    rings = spark.createDataFrame([("A", square(0.0)), ("B", square(1.0)), ("C", square(5.0))], "unit string, ring array<struct<x:double,y:double>>")
    assert [tuple(r) for r in topology.contacts(rings).collect()] == [("A", "B", 1.0)]
    column = spark.createDataFrame([("A", 0)], "unit string, rank long")
    with pytest.raises(Exception, match="not in the column"):
        topology.basal_contacts(topology.contacts(rings), column).collect()


def test_a_walk_ends_or_raises(spark):
    ids = spark.range(1, 201).withColumnRenamed("id", "id")
    chain = spark.range(1, 200).select(F.col("id").alias("younger"), (F.col("id") + 1).alias("older"))
    assert {(r.id, r.hops, r.last) for r in network.walk(ids, chain).collect()} == {(i, 200 - i, 200) for i in range(1, 201)}
    loop = spark.createDataFrame([(1, 2), (2, 1)], "younger long, older long")
    with pytest.raises(Exception, match="cycle"):
        network.walk(spark.range(1, 3), loop).collect()


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    lines = spark.range(5000).repartition(7).select(F.lit(0).alias("section"), F.col("id").alias("place"), F.concat(F.lit("v "), F.col("id"), F.lit(" 0 0")).alias("line"))
    folder = text.save(lines, str(tmp_path / "parts"))
    vertices, _ = files.surface_obj(spark, folder)
    assert vertices.where("X <> node").count() == 0 and vertices.count() == 5000
    one = text.joined(spark, folder, str(tmp_path / "one.obj"))
    with open(one, encoding="utf-8") as file:
        assert [x.split()[1] for x in file] == [str(i) for i in range(5000)]


@pytest.mark.parametrize(("source", "want"), [('{a: 1, "b": [1, 2,], /' + "/ c\n 'c': 'x'}", {"a": 1, "b": [1, 2], "c": "x"}), ("{x: {y: true}, # z\n}", {"x": {"y": True}}), ("[]", [])])
def test_loose_json(source, want):
    assert config.parse(source) == want


@pytest.mark.parametrize("bad", ["", "# only a comment", "{a 1}", "{a: }"])
def test_broken_json_raises(bad):
    with pytest.raises(ValueError):
        config.parse(bad)


def test_configuration_keeps_defaults_apart():
    one = config.Config().update({"fault": {"name_column": "TITLE"}}, lower=True)
    assert one.layers["fault"]["name_column"] == "title" and config.Config().layers["fault"]["name_column"] == "NAME"
    with pytest.raises(ValueError, match="unknown layer"):
        config.Config().update({"sea": {}})
    assert math.isclose(config.Config().layers["fault"]["minimum_fault_length"], -1.0)
