"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are runs of characters that are no ASCII punctuation, control or space, after A-Z became a-z.
A window is ten consecutive words of an item, or the whole of a shorter item. Windows are sets of
word shingles (three words, or the whole window if it is shorter) at positions. Texts are split into words
once and written; a first pass counts the benchmark's shingles over all documents; of each window, which must be contained whole, the rarest
one is the necessary prefix, and a window with a shingle that no document has drops out. A second pass
joins the documents with prefix shingles only; each match fixes where the window would start, and the
start and the end must lie within the document (length and position bounds). The third reads the
documents that still have a candidate and compares the whole window with their words, word by word.

Defined results: null and empty texts have no words and are clean; an item without words has no
window; equal items are both reported; rows that share an id are judged one by one, and give one
row each. Empty tables give an empty or a clean result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Benchmark shingles up to which they are broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 500_000
NAMES = ("w1", "w2", "w3")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null and empty: none."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), ""), F.array().cast("array<string>"))


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item and one row per window: its words."""
    each = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    return each.select("item", F.explode(F.transform(begins, lambda i: F.slice(F.col("w"), i, WINDOW))).alias("window"))


def _window_shingles(items: DataFrame) -> DataFrame:
    """wid, number of words, number of shingles, offset and the words of each shingle of each distinct window."""
    each = items.select("window").distinct().withColumn("wid", F.md5(F.array_join("window", " ")))
    places = F.sequence(F.lit(0), F.greatest(F.size("window") - SHINGLE, F.lit(0)))
    split = each.select("wid", F.size("window").alias("length"), F.size(places).alias("needed"), F.posexplode(F.transform(places, lambda i: F.slice(F.col("window"), i + 1, SHINGLE))).alias("offset", "s"))
    return split.select("wid", "length", "needed", "offset", F.get("s", F.lit(0)).alias("w1"), F.get("s", F.lit(1)).alias("w2"), F.get("s", F.lit(2)).alias("w3"))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated and the sorted list of items."""
    items = staged(_windows(benchmark, item_col, item_text), "leak-windows")
    shingles = staged(_window_shingles(items), "leak-shingles").withColumn("sid", F.concat_ws(" ", *NAMES))
    # shorter windows need shorter shingles of the documents; most benchmarks have none
    short = [n for (n,) in shingles.where(F.col("length") < SHINGLE).select("length").distinct().collect()]
    texts = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col).cast("string")).alias("w")).withColumn("n", F.size("w")), "leak-texts")

    counts = _met(texts, _known(shingles.select("sid", *NAMES).distinct()), short).groupBy("sid").agg(F.count("*").alias("count"))
    rarity = shingles.join(counts, "sid", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "sid", "offset", *NAMES)).alias("rare"), F.first("length").alias("length"))
    prefix = staged(rarity.where("rare.count > 0").select("wid", "length", "rare.*").drop("count"), "leak-prefixes")

    found = _met(texts, _known(prefix), short).withColumn("start", F.col("pos") - F.col("offset"))
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))).select("row", "start", "wid")
    windows = items.select("window").distinct().withColumn("wid", F.md5(F.array_join("window", " ")))
    # a document has at most as many candidates as it has words times the windows that share a shingle
    candidates = found.join(windows, "wid").groupBy("row").agg(F.collect_list(F.struct("start", "wid", "window")).alias("c"))
    holds = lambda c: F.slice("w", c["start"] + 1, F.size(c["window"])) == c["window"]
    hits = staged(texts.select("row", "w").join(candidates, "row").select("row", F.transform(F.filter("c", holds), lambda c: F.struct(c["start"].alias("start"), c["wid"].alias("wid"), F.size(c["window"]).alias("length"))).alias("c")).where(F.size("c") > 0), "leak-hits")

    at = F.flatten(F.transform("c", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))
    n_hit = hits.select("row", F.size(F.array_distinct(at)).alias("n_hit"))
    owners = items.select("item", F.md5(F.array_join("window", " ")).alias("wid")).distinct()
    each = hits.select("row", F.explode(F.array_distinct(F.transform("c", lambda c: c["wid"]))).alias("wid"))
    owned = each.join(owners, "wid").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = texts.select("row", "id", F.col("n").cast("bigint").alias("n_words")).join(n_hit, "row", "left").join(owned, "row", "left")
    none = F.array().cast("array<string>")
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def _known(shingles: DataFrame) -> DataFrame:
    """Shingles with the number that they are joined by and the words that are compared; broadcast up to BROADCAST_ROWS."""
    filled = shingles.withColumns({c: F.coalesce(c, F.lit("")) for c in NAMES})
    known = filled.withColumns({"h": F.xxhash64(*NAMES), "key": F.concat_ws("\n", *NAMES)}).drop(*NAMES)
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known


def _met(texts: DataFrame, known: DataFrame, short: list[int]) -> DataFrame:
    """row, n (words of the text), pos and the columns of `known` for each place of a text that begins a known shingle."""
    blank = F.lit("")
    shifted = [F.slice("w", j + 1, F.greatest(F.size("w"), F.lit(1))) for j in range(SHINGLE)]
    rows = F.arrays_zip(*shifted).cast("array<struct<w1:string,w2:string,w3:string>>")
    spread = texts.select("row", "n", F.posexplode(rows).alias("pos", "s"))
    spread = spread.select("row", "n", "pos", *[F.coalesce(F.col(f"s.{c}"), blank).alias(c) for c in NAMES])

    def met(some: DataFrame) -> DataFrame:
        """Joined on one number; the words themselves are compared where it matches."""
        keyed = some.select("row", "n", "pos", F.xxhash64(*NAMES).alias("h"), *NAMES)
        same = F.array_contains(F.array("key"), F.concat_ws("\n", *NAMES))  # written so that it isn't taken as a join key
        return keyed.join(known, "h").where(same).drop("h", "key", *NAMES)

    out = met(spread)
    for size in short:  # a shingle of one or two words, before the last place, where it was met above
        cut = [F.col(c) if j < size else blank for j, c in enumerate(NAMES)]
        inner = spread.where(F.col("n") - F.col("pos") > size)
        out = out.unionByName(met(inner.select("row", "n", "pos", *[x.alias(c) for x, c in zip(cut, NAMES, strict=True)])))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without those that hold a window of the benchmark; of rows that share an id and a text, all or none stay."""
    key = F.xxhash64(F.col(text_col))
    marked = docs.select(F.struct(F.col(id_col).alias("id"), key.alias("tie")).alias("__row"), F.col(text_col).alias("text"))
    bad = scan(marked, benchmark, "__row", "text").where("contaminated").select(F.col("__row.id").alias("__id"), F.col("__row.tie").alias("__tie")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & key.eqNullSafe(F.col("__tie")), "left_anti")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item, list_aggregate(w[s:s+9], 'string_agg', ' ') AS win, least(len(w), 10) AS size FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM i),
p AS (SELECT doc_id, s, size, list_aggregate(w[s:s+size-1], 'string_agg', ' ') AS win FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM d, z WHERE len(w) >= size)),
h AS (SELECT p.doc_id, p.s, p.size, i.item FROM p JOIN i ON p.win = i.win),
a AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS pos FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(a.n_hit, 0) AS n_hit, coalesce(c.n_items, 0) AS n_items, sha256(coalesce(c.items, '')) AS items_sha256, coalesce(a.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)
"""
