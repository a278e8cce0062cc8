"""The nearest and cluster queries over every vertex give what comparing all with all gives."""

from __future__ import annotations

import numpy as np
import pytest

from strataspark import catalogue
from strataspark.operators import relations
from strataspark.sources.views import view


@pytest.fixture(scope="module")
def vertices(spark, sf_dir):
    return sorted(tuple(r) for r in view(spark, sf_dir, "trace_vertices").select("trace_id", "seq", "X", "Y").collect())


def rows(spark, sf_dir, name):
    return {(r.trace_id, r.seq): r for r in catalogue.queries()[name](spark, sf_dir).collect()}


def apart(xy, other):
    return np.sqrt(((xy[:, None, :] - other[None, :, :]) ** 2).sum(axis=2))


def test_every_vertex_has_its_nearest_centre_and_weight(spark, sf_dir, vertices):
    trace = np.array([v[0] for v in vertices])
    xy = np.array([v[2:] for v in vertices])
    ids = np.unique(trace)
    d = apart(xy, np.array([np.round(xy[trace == i].mean(axis=0) + 1e-9, 6) for i in ids]))
    near, weight = rows(spark, sf_dir, "vertex_nearest_orientation"), rows(spark, sf_dir, "vertex_regularisation_weight")
    assert len(near) == len(weight) == len(vertices)
    for i, v in enumerate(vertices):
        assert near[v[:2]].cid == ids[d[i].argmin()]
        assert near[v[:2]].distance == pytest.approx(d[i].min(), abs=1e-4)
        assert weight[v[:2]].w == pytest.approx(1 + 2 * np.exp(-(d[i].min() ** 2) / 5000), abs=1e-5)


def test_every_vertex_is_filled(spark, sf_dir, vertices):
    known = [v for v in vertices if v[3] < 150]
    d = apart(np.array([v[2:] for v in vertices]), np.array([v[2:] for v in known]))
    got = rows(spark, sf_dir, "vertex_fill_nearest")
    assert len(got) == len(vertices)
    for i, v in enumerate(vertices):
        assert got[v[:2]].v == (v[3] if v[3] < 150 else known[d[i].argmin()][3])


def linked(xy, reach):
    """The smallest index of each point's cluster."""
    near, label = apart(xy, xy) <= reach, np.arange(len(xy))
    while True:
        low = np.where(near, label[None, :], len(xy)).min(axis=1)
        if (low == label).all():
            return label
        label = low


def test_every_vertex_has_its_cluster(spark, sf_dir, vertices):
    label = linked(np.array([v[2:] for v in vertices]), 4.0)
    got = rows(spark, sf_dir, "vertex_cluster_collocated")
    assert len(got) == len(vertices)
    assert all((got[v[:2]].cluster_trace, got[v[:2]].cluster_seq) == vertices[label[i]][:2] for i, v in enumerate(vertices))


def test_a_long_chain_and_dense_spots_are_clusters(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    xy = np.concatenate([np.stack([np.arange(300) * 1.5, np.zeros(300)], axis=1), rng.normal(0, 1, (200, 2)) + [0, 50], rng.uniform(-40, 0, (200, 2))])
    order = rng.permutation(len(xy))
    label = linked(xy[order], 2.0)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy[order])] + [(9999, None, 1.0)], "k long, x double, y double")
    got = {r.k: r.cluster for r in relations.clusters(df, "k", "x", "y", 2.0).collect()}
    assert got == dict(enumerate(label.tolist())) | {9999: 9999}


def test_dense_places_cost_no_pairs_and_no_broadcast(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    band = lambda y: np.stack([rng.uniform(0, 12, 400), rng.uniform(y, y + 0.5, 400)], axis=1)
    bridge = [[6.0, 7.5 + i * 1.9] for i in range(3)]
    xy = np.concatenate([band(0), band(2.3), band(5), band(14), bridge, rng.uniform(-30, 0, (60, 2))])
    xy = xy[rng.permutation(len(xy))]
    staged = []
    cut = relations._cut

    def seen(df):
        out = cut(df)
        staged.append((out.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(relations, "_cut", seen)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "k long, x double, y double")
    found = relations.clusters(df, "k", "x", "y", 2.0)
    assert {r.k: r.cluster for r in found.collect()} == dict(enumerate(linked(xy, 2.0).tolist()))
    assert max(n for n, _ in staged) < 3 * len(xy)  # the places within reach of each other are over 100 pairs for each
    plans = [p for _, p in staged] + [found._jdf.queryExecution().optimizedPlan().toString()]
    assert any("Join" in p for p in plans)
    assert all("strategy=merge" in x for p in plans for x in p.splitlines() if "Join " in x)


def test_far_points_find_the_nearest(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    to, at = np.concatenate([rng.normal(0, 1, (300, 2)), rng.uniform(-500, -400, (20, 2))]), rng.uniform(-1000, 1000, (300, 2))
    frame = lambda xy, k: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], f"{k} long, X double, Y double")
    got = {r.p: r.t for r in relations.nearest(frame(at, "p"), frame(to, "t"), "p", "t").collect()}
    assert got == dict(enumerate(apart(at, to).argmin(axis=1).tolist()))
