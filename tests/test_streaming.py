"""A stream's closed windows equal the table's."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from strataspark import catalogue
from strataspark.sources.views import view
from strataspark.streaming import logs


def test_tumbling_windows_of_a_stream(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    query = logs.windows(logs.stream(spark, str(tmp_path / "in"), schema), "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    tidy = lambda df: {(r.start, r.stage): (r.n, round(r.total_s, 6)) for r in df.collect()}
    assert tidy(spark.table("windows")) == tidy(logs.windows(view(spark, sf_dir, "log_records"), "1 hour").where(F.lit(True)))


@pytest.mark.parametrize("name", ["log_tumbling", "log_sliding"])
def test_times_within_half_a_millisecond_of_a_window(spark, tmp_path, name):
    at = lambda *t: datetime.datetime(2024, 1, 1, *t)
    times = [at(0, 59, 59, 999_499), at(0, 59, 59, 999_500), at(0, 59, 59, 999_999), at(1), at(1, 29, 59, 999_499), at(1, 29, 59, 999_500), at(1, 30, 0, 499), datetime.datetime(1971, 5, 5, 4, 59, 59, 999_501)]
    rows = [(i, t, 1, "click", 0.25 * i) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)
