"""A model's recipe: one JSON document of its box, column and features, with its observations by path.

Observations stay in the table that the recipe names, however large; the document holds only what
grows with the model: units and features, each at most MOST_ENTRIES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ENTRIES = 10_000
_BOX = "struct<origin: array<double>, maximum: array<double>, nsteps: array<bigint>>"
_UNIT = "struct<grp: bigint, pos: bigint, unit: string, thickness: double>"
_FEATURE = "struct<name: string, kind: string, faults: array<string>>"
_SOURCE = "struct<kind: string, path: string, dataframe: struct<columns: array<string>, data: array<array<string>>>>"
SCHEMA = f"schema string, version int, model struct<bounding_box: {_BOX}, stratigraphic_column: array<{_UNIT}>, features: array<{_FEATURE}>, data_source: {_SOURCE}>"
#: Columns of observations that are text; all others are numbers.
TEXT = ("feature_name", "name", "unit")


@dataclass
class Recipe:
    """The box is (origin, maximum, nsteps); features have `name`, `kind` and the `faults` that are features too."""

    box: tuple[list[float], list[float], list[int]]
    column: DataFrame
    features: DataFrame
    data: DataFrame | None


def save(path: str, box: tuple[list[float], list[float], list[int]], column: DataFrame, features: DataFrame, data_path: str | None = None) -> str:
    """Writes the document to a new folder `path`; `column` has grp, pos, unit, thickness, `features` name, kind, faults."""
    units = column.select(F.struct(*[F.col(n).cast(t).alias(n) for n, t in (("grp", "bigint"), ("pos", "bigint"), ("unit", "string"), ("thickness", "double"))]).alias("e"))
    named = features.select(F.struct("name", "kind", "faults").alias("e"))
    for kind, entries in (("units", units), ("features", named)):
        if len(entries.limit(MOST_ENTRIES + 1).tail(MOST_ENTRIES + 1)) > MOST_ENTRIES:
            raise ValueError(f"a recipe of more than {MOST_ENTRIES} {kind}")
    lists = [e.agg(F.sort_array(F.collect_list("e")).alias(n)) for e, n in ((units.select(F.struct("e.grp", "e.pos", "e.unit", "e.thickness").alias("e")), "stratigraphic_column"), (named, "features"))]
    origin, maximum, steps = (F.array(*[F.lit(v).cast(t) for v in values]) for values, t in zip(box, ("double", "double", "bigint"), strict=True))
    source = F.struct(F.lit("reference").alias("kind"), F.lit(data_path).alias("path")) if data_path else F.lit(None).cast("struct<kind: string, path: string>")
    model = F.struct(F.struct(origin.alias("origin"), maximum.alias("maximum"), steps.alias("nsteps")).alias("bounding_box"), "stratigraphic_column", "features", source.alias("data_source"))
    document = F.to_json(F.struct(F.lit("GeologicalModelRecipe").alias("schema"), F.lit(1).alias("version"), model.alias("model")))
    lists[0].crossJoin(lists[1]).select(document.alias("value")).coalesce(1).write.text(path)  # one row each
    return path


def load(spark: SparkSession, path: str) -> Recipe:
    """The recipe in a file or folder. One without a box or with an unnamed feature, and an unknown kind of data, raise."""
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    row = whole.select("model.bounding_box", "model.data_source", F.exists(F.coalesce("model.features", F.array().cast(f"array<{_FEATURE}>")), lambda f: f["name"].isNull()).alias("unnamed")).first()
    if row is None or row.bounding_box is None or row.bounding_box.origin is None or row.bounding_box.maximum is None:
        raise ValueError("a recipe needs a bounding_box")
    if row.unnamed:
        raise ValueError("each feature needs a name")
    box = row.bounding_box
    features = whole.select(F.explode("model.features").alias("f"), F.transform("model.features", lambda f: f["name"]).alias("all"))
    kept = F.array_intersect(F.coalesce("f.faults", F.array().cast("array<string>")), "all")
    return Recipe(
        (box.origin, box.maximum, box.nsteps),
        whole.select(F.inline("model.stratigraphic_column")),
        features.select("f.name", "f.kind", kept.alias("faults")),
        _observations(spark, whole, row.data_source),
    )


def _observations(spark: SparkSession, whole: DataFrame, source) -> DataFrame | None:
    if source is None or source.kind is None:
        return None
    if source.kind == "reference":
        return spark.read.option("header", True).option("inferSchema", True).csv(source.path) if source.path.endswith(".csv") else spark.read.parquet(source.path)
    if source.kind != "inline" or source.dataframe is None:
        raise ValueError(f"unsupported kind of data: {source.kind}")
    rows = whole.select(F.explode("model.data_source.dataframe.data").alias("r"))
    number = {n: F.get("r", F.lit(i)).try_cast("double") for i, n in enumerate(source.dataframe.columns)}
    return rows.select(*[F.get("r", F.lit(i)).alias(n) if n in TEXT else F.when(~F.isnan(number[n]), number[n]).alias(n) for i, n in enumerate(source.dataframe.columns)])
