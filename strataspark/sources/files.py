"""Readers of the files that `sinks.text` writes, and of tables as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(df: DataFrame) -> DataFrame:
    """Rows of (file, block, inner, line) with their number among all: counts of whole splits are summed first."""
    sizes = df.groupBy("file", "block").agg(F.count("*").alias("n"))
    order = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("inner")) - 1
    return df.withColumn("place", place).join(before, ["file", "block"]).withColumn("number", F.col("before") + F.col("place")).drop("before", "place")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, inner and line: enough to find the order of the lines again."""
    df = spark.read.text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("inner"), F.col("value").alias("line"))


def _numbers(df: DataFrame, first: int, names: list[str], kind: str) -> list:
    return [F.get(F.split("line", " "), F.lit(first + i)).cast(kind).alias(n) for i, n in enumerate(names)]


def surface_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles); numbers follow the order of the lines."""
    every = lines(spark, path)
    v = numbered(every.where(F.col("line").startswith("v ")))
    t = numbered(every.where(F.col("line").startswith("f ")))
    corners = [(c - 1).alias(n) for c, n in zip([F.get(F.split("line", " "), F.lit(i)).cast("bigint") for i in (1, 2, 3)], ("n1", "n2", "n3"), strict=True)]
    return v.select(F.col("number").alias("node"), *_numbers(v, 1, ["X", "Y", "Z"], "double")), t.select(F.col("number").alias("triangle"), *corners)


def surface_gocad(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    every = lines(spark, path)
    words = F.split("line", " ")
    v = every.where(F.col("line").rlike("^P?VRTX ")).select((F.get(words, F.lit(1)).cast("bigint") - 1).alias("node"), *_numbers(every, 2, ["X", "Y", "Z"], "double"))
    t = every.where(F.col("line").startswith("TRGL "))
    t = numbered(t).select(F.col("number").alias("triangle"), *[(F.get(words, F.lit(i)).cast("bigint") - 1).alias(f"n{i}") for i in (1, 2, 3)])
    return v, t


def points_gocad(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    every = lines(spark, path).where(F.col("line").rlike("^P?VRTX "))
    return every.select(F.get(F.split("line", " "), F.lit(1)).cast("bigint").alias("number"), *_numbers(every, 2, ["X", "Y", "Z", *values], "double"))


def vtk_numbers(spark: SparkSession, path: str, after: str, count: int) -> DataFrame:
    """The `count` lines after the first line that begins with `after`: number and line."""
    every = numbered(lines(spark, path))
    head = every.where(F.col("line").startswith(after)).agg(F.min("number").alias("head"))
    return every.crossJoin(F.broadcast(head)).where((F.col("number") > F.col("head")) & (F.col("number") <= F.col("head") + count)).select((F.col("number") - F.col("head") - 1).alias("number"), "line")


def wkt_rings(spark: SparkSession, path: str) -> DataFrame:
    """number and ring (array of x, y) from lines of an id, a tab and well-known text of a polygon or line."""
    df = spark.read.text(path)
    body = F.regexp_extract("value", r"\(+([^()]*)\)+", 1)
    place = lambda p: F.struct(F.get(F.split(p, " "), F.lit(0)).cast("double").alias("x"), F.get(F.split(p, " "), F.lit(1)).cast("double").alias("y"))
    return df.select(F.get(F.split("value", "\t"), F.lit(0)).cast("bigint").alias("number"), F.transform(F.split(body, ", "), place).alias("ring"))


def raster_ascii(spark: SparkSession, path: str, size: tuple[int, int]) -> DataFrame:
    """px, py and value of an ASCII grid; the value for no data is NULL."""
    every = numbered(lines(spark, path).where(F.col("line").rlike("^[-0-9]")))
    cells = every.select((size[1] - 1 - F.col("number")).alias("py"), F.posexplode(F.split("line", " ")).alias("px", "v"))
    return cells.select("px", "py", F.nullif(F.col("v").cast("double"), F.lit(-9999.0)).alias("value"))


def voxet_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The words after each key of a voxet's header, which is a few lines."""
    return {r.line.split(" ")[0]: r.line.split(" ")[1:] for r in lines(spark, path).where(F.col("line").startswith("AXIS_")).collect()}


#: The columns of a table of constraints in CSV.
POINTS = T.StructType([T.StructField("pid", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("X", "Y", "Z", "val")], T.StructField("feature_name", T.StringType())])


def points_csv(spark: SparkSession, path: str, schema: T.StructType = POINTS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def horizontal(spark: SparkSession, wave: float = 0.0) -> DataFrame:
    """Two layers of 10 x 10 points with values 2 and 3; the upper one may be a wave along X."""
    n = F.col("id")
    x, y, upper = F.floor(n % 100 / 10) * 1.0, (n % 10) * 1.0, n >= 100
    high = F.lit(3.0) + wave + F.sin(F.lit(3.141592653589793 / 6) * x + 3.141592653589793 / 2) * wave
    return spark.range(200).select(x.alias("X"), y.alias("Y"), F.when(upper, high).otherwise(2.0).alias("Z"), F.when(upper, 3.0).otherwise(2.0).alias("val"), F.lit("strati").alias("feature_name"))
