"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions only.

A window is three consecutive lines that aren't blank. Its hash is the md5 of the three lines. Of
all windows with the same hash the first one, by id, then text hash, then position, stays where it
is; every later one covers its lines, and the blank lines between them. A line that any later
window covers goes, so overlapping windows are merged into one covered stretch.

Defined results: null text stays null and has no lines; texts of fewer than three lines that aren't
blank are never changed; rows that repeat id and text are one document and get the same result;
rows with a null id come before all others and count as one id. Extra columns are dropped by
`line_dedup` and kept by `deduplicated`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _numbered(lines: Column) -> Column:
    """The lines that aren't blank, with their positions among all lines."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: F.trim(F.regexp_replace(x["line"], "[\\t\\r\\x0B\\f]", " ")) != "")


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text hash, and first and last line of every window with its hash; one row per occurrence."""
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), _numbered(_lines(text_col)).alias("n")).where(F.size("n") >= WINDOW)

    def one(i: Column) -> Column:
        rows = [F.element_at(F.col("n"), i + j) for j in range(1, WINDOW + 1)]
        return F.struct(rows[0]["at"].alias("start"), rows[-1]["at"].alias("stop"), F.unhex(F.md5(F.concat_ws("\n", *[r["line"] for r in rows]))).alias("hash"))

    return kept.select("id", "tie", F.explode(F.transform(F.sequence(F.lit(0), F.size("n") - WINDOW), one)).alias("w")).select("id", "tie", "w.start", "w.stop", "w.hash")


def covered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text hash and the merged stretches [start, stop] of lines that later windows cover."""
    found = windows(docs, id_col, text_col)
    place = F.struct("id", "tie", "start")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first")
    later = found.join(first, "hash").where(~place.eqNullSafe(F.col("first"))).groupBy("id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("w"))
    # a window is new ground if it starts after the end of the one before it: all are three lines long, so ends rise with starts
    head = F.filter(F.col("w"), lambda x, i: (i == 0) | (x["start"] > F.element_at(F.col("w"), F.greatest(i, F.lit(1)))["stop"]))
    tail = F.filter(F.col("w"), lambda x, i: (i == F.size("w") - 1) | (x["stop"] < F.element_at(F.col("w"), F.least(i + 2, F.size("w")))["start"]))
    return later.select("id", "tie", F.zip_with(head, tail, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop"))).alias("gone"))


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    gone = covered(docs, id_col, text_col).select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("gone").alias("__gone"))
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__tie")), "left")
    lines, cuts = _lines(text_col), F.col("__gone")
    begin = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["stop"] + 1))
    end = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(lines, a + 1, b - a)))
    text = F.when(cuts.isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    removed = F.when(cuts.isNull(), F.lit(0)).otherwise(F.aggregate(cuts, F.lit(0), lambda n, c: n + c["stop"] - c["start"] + 1))
    return both, text, removed


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_removed, and the text without later occurrences of repeated windows."""
    both, text, removed = _joined(docs, id_col, text_col)
    count = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    return both.select(F.col(id_col), count.cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"), text.alias("text"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with all its columns and the shortened texts; a text whose lines all go becomes empty."""
    both, text, _ = _joined(docs, id_col, text_col)
    return both.withColumn(text_col, text).select(*docs.columns)


#: Blank characters and the order of rows are the same in both engines; a null id sorts first.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d),
n AS (SELECT doc_id, text, pos, line,
  lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(pos, 2) OVER w AS stop
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
w AS (SELECT *, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id NULLS FIRST, pos) AS nth FROM n WHERE stop IS NOT NULL),
g AS (SELECT DISTINCT l.doc_id, l.text, l.pos FROM l JOIN w ON l.doc_id IS NOT DISTINCT FROM w.doc_id AND l.text = w.text AND w.nth > 1 AND l.pos BETWEEN w.pos AND w.stop),
k AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.pos = g.pos GROUP BY l.doc_id, l.text)
SELECT o.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.kept AS text
FROM documents o LEFT JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text
"""
