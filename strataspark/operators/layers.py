"""Map layers: parsing and checking whole layers in one pass each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """What a layer must have; optional columns give warnings."""

    ids: Sequence[str] = ()
    required: Sequence[str] = ()
    optional: Sequence[str] = ()
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """field, rule, severity and the number of rows that break it; for a text rule the number that have the text.

    A column that must be there and isn't counts as one broken rule. All counts come from one aggregation.
    """
    tests: list[tuple[str, str, str, Column]] = []
    for severity, names in (("error", rules.required), ("warning", rules.optional)):
        for c in names:
            if c not in df.columns:
                if severity == "error":
                    tests.append((c, "missing column", severity, F.lit(1)))
                continue
            tests.append((c, "null", severity, F.count_if(F.col(c).isNull())))
            if dict(df.dtypes)[c] == "string":
                tests.append((c, "blank", severity, F.count_if(F.trim(c) == "")))
    for c, (low, high) in rules.ranges.items():
        tests.append((c, "range", "error", F.count_if(F.col(c).isNull() | ~F.col(c).between(low, high))))
    for c in rules.ids:
        tests.append((c, "duplicate", "error", F.count("*") - F.count_distinct(c)))
    for c, text in rules.texts.items():
        tests.append((c, "text", "error", F.count_if(F.lower(c).contains(text))))
    counts = df.agg(*[n.cast("bigint").alias(f"t{i}") for i, (_, _, _, n) in enumerate(tests)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(f"t{i}").alias("n")) for i, (c, r, s, _) in enumerate(tests)]))
    return counts.select(rows.alias("r")).select("r.*")


def lines_layer(df: DataFrame, least: int, words: Sequence[str], name: str = "unit", number: str = "ID", text: str = "description") -> DataFrame:
    """A layer of faults or folds: those that are long enough, named, with flags by words, dips of nought unknown and default ages."""
    words_in = F.lower(F.coalesce(text, F.lit("")))
    size = F.length(F.coalesce(text, F.lit("")))
    named = F.coalesce(name, F.concat(F.lit("Fault_"), F.col(number).cast("string")))
    return df.where(size >= least).select(F.col(number).alias("id"), named.alias("name"), size.cast("bigint").alias("size"), words_in.rlike("|".join(words)).alias("is_fold"), words_in.contains(words[0]).alias("syncline"), F.nullif("dip", F.lit(0.0)).alias("dip"), F.coalesce("quality", F.lit(0)).alias("min_age"), F.coalesce(F.col("toxic") * 1000, F.lit(100000)).alias("max_age"))


def dissolved(df: DataFrame, unit: str, size: Column, number: str = "ID") -> DataFrame:
    """One row per unit: the number of its parts, the first id and the sum of sizes."""
    return df.groupBy(unit).agg(F.count("*").alias("n_parts"), F.min(number).alias("first_id"), F.sum(size).cast("bigint").alias("size"))


def geometry_check(df: DataFrame, ring: str) -> DataFrame:
    """Per kind of geometry the number of rows and of those that aren't valid: too few places, not closed, or without an area."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"])
    kind = F.when(F.size(ring) == 1, "point").when((F.size(ring) > 3) & closed, "polygon").otherwise("line")
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring)), lambda a, b: F.coalesce(a["x"] * b["y"] - b["x"] * a["y"], F.lit(0.0)))
    area = F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2.0
    bad = ((kind == "polygon") & (area <= 0)) | (F.size(ring) == 0)
    return df.select(kind.alias("kind"), bad.alias("bad")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_invalid"))
