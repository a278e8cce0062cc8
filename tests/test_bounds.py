"""Long columns, repeated places and cycles, against brute force."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strataspark.operators import column, relations, statistics
from strataspark.plans import bands


def test_many_bands_give_what_a_scan_gives(spark):
    rows = [(float(i), float(i + 1 + i % 3), i) for i in range(150)] + [(None, 3.0, 900), (140.0, None, 901), (20.0, 90.0, 902)]
    values = [None, -5.0, 0.0, 2.5, 20.0, 20.5, 75.0, 75.25, 89.999, 90.0, 149.5, 1000.0, math.nan]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.b for r in frame.select("i", bands.case_of(F.col("v"), rows, -1).alias("b")).collect()}
    for i, v in enumerate(values):
        want = -1
        for low, high, name in rows if v is not None else []:
            if (low is None or v > low or math.isnan(v)) and (high is None or v < high):
                want = name
        assert got[i] == want, v


def test_a_column_beyond_its_bound_raises(spark, monkeypatch):
    monkeypatch.setattr(column, "MOST_UNITS", 2)
    units = spark.createDataFrame([(0, i, f"u{i}", 1.0) for i in range(3)], "grp int, pos int, unit string, thickness double")
    with pytest.raises(ValueError, match="more than 2 units"):
        column.small(units)


def test_semivariogram_of_repeated_places_and_nulls(spark):
    rows = [(k, float((k * 7) % 5 * 2), float((k * k) % 11)) for k in range(40)] + [(90, None, 1.0), (91, 2.0, None), (None, 4.0, 3.0)]
    got = {r.lag: (r.n_pairs, r.gamma) for r in statistics.semivariogram(spark.createDataFrame(rows, "k int, x double, v double"), "x", "v", 2.5, 3, "k").collect()}
    want: dict[int, list[float]] = {}
    known = [(x, v) for _, x, v in rows if x is not None and v is not None]
    for x, v in known:
        for y, w in known:
            d = abs(x - y)
            lag = math.floor(d / 2.5 + 0.5)
            if d < 6.25 and d != (lag - 0.5) * 2.5:
                want.setdefault(lag, []).append((v - w) ** 2)
    assert set(got) == set(want)
    for lag, squares in want.items():
        assert got[lag][0] == len(squares)
        assert got[lag][1] == pytest.approx(sum(squares) / len(squares))


def test_closure_of_a_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d"), ("e", "f")]
    got = {(r.a, r.b) for r in relations.closure(spark.createDataFrame(edges, "x string, y string"), "x", "y").collect()}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert got == want
