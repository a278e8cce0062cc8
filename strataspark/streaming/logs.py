"""Summaries of structured log records; the same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def timed(records: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Time as an instant, with a watermark on a stream."""
    out = records.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if out.isStreaming else out


def to_milliseconds(records: DataFrame, ts: str = "ts") -> DataFrame:
    """Time in whole milliseconds, halves away from 1970, as `epoch_ms` counts it: the last half millisecond of an hour is in the next."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    half = F.when(micros < 0, F.lit(-500)).otherwise(F.lit(500))
    return records.withColumn(ts, F.timestamp_millis(F.call_function("div", micros + half, F.lit(1000))))


def stage_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("stage").agg(F.count("*").alias("n"), F.avg("duration_s").alias("mean_s"), F.min("duration_s").alias("min_s"), F.max("duration_s").alias("max_s"))


def windows(records: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = timed(records).groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("duration_s").alias("total_s"))
    return got.select(F.col("w.start").alias("start"), "stage", "n", "total_s")


def sessions(records: DataFrame, gap: str) -> DataFrame:
    """Runs of one run's records without a pause of `gap`."""
    got = timed(records).groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count("*").alias("n"), F.sum("duration_s").alias("total_s"))
    return got.select("run_id", F.col("w.start").alias("start"), "n", "total_s")


def query(records: DataFrame, stage: str | None = None, run_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Records by stage and run in the order of their ids."""
    for c, v in (("stage", stage), ("run_id", run_id)):
        if v is not None:
            records = records.where(F.col(c) == v)
    records = records.orderBy("id")
    return records.limit(limit) if limit else records


def stream(spark: SparkSession, folder: str, schema: T.StructType = SCHEMA, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of log records."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration_s"))
