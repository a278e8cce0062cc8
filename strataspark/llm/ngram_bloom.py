"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting: every text gives its words and pairs of neighbouring tokens. Texts are written once, cut
into runs of a few MB; tasks count a run with numpy and send sorted blobs of (hash, count), dealt
into buckets by hash; each bucket is merged once. A word in every text costs one entry per run, so
no key is hot. Held-out texts send their n-grams with a count of 0, as questions only.

Filter: a count c is held as its level j, where THRESHOLDS[j - 1] <= c < THRESHOLDS[j]; these grow by
one, then by Q. The n-gram is inserted once for every level up to its own, and a lookup probes level
after level until one is missing. Each bucket has a segment of the filter, as large as its n-grams
need, so the filter grows with the corpus and every count from 1 on is held. No task has more than a
bucket's segment: the task that builds it also answers the runs' blobs, one byte for each n-gram, and
the answers meet the texts of their run.

Score: low(x) and high(x) are the least and the greatest count of the level held for x.
    p(w) = (low(w) + 0.1) / (sum of low over the words + 0.1 * (V + 1))
    p(w | v) = (min(low(vw), high(v), high(w)) + mu * p(w)) / (high(v) + ghosts + mu)
As low never exceeds a count and high is never under one, p(w | v) over all words and one unseen word
sums to at most 1, and to at least 1 / Q**2, as high < Q * low at every level. A pair
that was never counted may be taken for one by chance; `ghosts` is what such pairs are expected to
add to a context, the segments' chance of it times V. mu is the strength at which a Dirichlet process
over the counted words would show as many distinct pairs as were counted; it comes from the counts
of the whole corpus.

The base score is exact: words above a count so that at most `table` of them remain are looked up
in a broadcast table; all others are joined with their counts.

Defined results: null and empty texts have one token, the end; rows that repeat an id are scored one
by one; a null id counts as empty text in the fold; with no training text N and V are 0 and every
score is that of unseen tokens. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textvec as tv
from .common import fold, staged

U64 = np.uint64
FOLDS = 10
#: Bytes of text in a run, and for each bucket.
RUN_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Growth of the levels, bits for each inserted level, and probes.
Q, BITS, PROBES = 1.2, 20, 7
BEGIN, PAIR = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
_LOW48 = U64((1 << 48) - 1)


def _thresholds() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * Q)))
    return np.array(out, np.int64)


#: The least count of each level, from level 1 on.
THRESHOLDS = _thresholds()
LEVELS = len(THRESHOLDS) + 1
LOW = np.concatenate([[0], THRESHOLDS]).astype(float)
HIGH = np.concatenate([[0], THRESHOLDS[1:] - 1, [1 << 62]]).astype(float)


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the token before each (BEGIN for the first) and the offsets of the texts."""
    hashes, offsets = tv.words(column)
    count = len(offsets) - 1
    ends = offsets + np.arange(count + 1)
    out = np.empty(len(hashes) + count, np.uint64)
    last = ends[1:] - 1
    word = np.ones(len(out), bool)
    word[last] = False
    out[word], out[last] = hashes, tv.END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends[:-1]] = BEGIN
    return out, before, ends


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tv.mix((before ^ PAIR) * tv.BASE + token)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(40)) % U64(buckets)).astype(np.int32)


def _pack(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _width(kind: int) -> int:
    """Bytes of a key: whole hashes of words, 48 bits besides the bucket for pairs."""
    return 8 if kind == 1 else 6


def _placed(texts: DataFrame) -> DataFrame:
    """The texts, written once, with their `run` and a `row` that rises within it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in tv.chunks(batches, "text", 2 << 20):
            ends = size + np.cumsum(pc.binary_length(tv.as_large(batch.column("text"))).to_numpy())
            run = np.concatenate([[size], ends[:-1]]) // RUN_BYTES
            row = np.arange(rows, rows + batch.num_rows)
            rows, size = rows + batch.num_rows, int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + run.astype(np.int64)), pa.array(base + row)], [*batch.schema.names, "run", "row"])

    added = [StructField(c, LongType()) for c in ("run", "row")]
    return staged(texts.mapInArrow(place, StructType([*texts.schema.fields, *added])), "ngram-texts")


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the distinct hashes goes in the order of buckets, and the bounds of the buckets."""
    at = _bucket(hashes, buckets)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def _counted(texts: DataFrame, buckets: int) -> DataFrame:
    """Per piece of a run (from row `first` on) and bucket: sorted keys of words and pairs, and their counts."""

    def flush(run: int, first: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, both, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        columns, filled = {}, np.zeros(buckets, bool)
        for kind, hashes in ((1, token), (2, both)):
            keys, back = np.unique(hashes, return_inverse=True)
            order, bounds = _dealt(keys, buckets)
            counts = np.bincount(back, weight, len(keys)).astype("<u4")[order]
            columns[kind] = keys[order], counts, bounds
            filled |= np.diff(bounds) > 0
        some = np.flatnonzero(filled)
        out = [pa.array(np.full(len(some), x, np.int64)) for x in (run, first)] + [pa.array(some.astype(np.int32))]
        for kind, (keys, counts, bounds) in columns.items():
            out += [pa.array([_pack(keys[bounds[b] : bounds[b + 1]], _width(kind)) for b in some], pa.binary()), pa.array([counts[bounds[b] : bounds[b + 1]].tobytes() for b in some], pa.binary())]
        return pa.RecordBatch.from_arrays(out, ["run", "first", "bucket", "k1", "c1", "k2", "c2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        run = first = -1
        for batch in tv.chunks(batches, "text", 2 << 20):
            runs = batch.column("run").to_numpy()
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and runs[a] != run:
                    yield flush(run, first, held)
                    held = []
                if not held:
                    run, first = int(runs[a]), batch.column("row")[a].as_py()
                token, before, ends = tokens(batch.column("text").slice(a, b - a))
                kept = ~np.asarray(batch.column("held_out").slice(a, b - a).to_numpy(zero_copy_only=False), bool)
                held.append((token, pair(before, token), np.repeat(kept, np.diff(ends))))
        if held:
            yield flush(run, first, held)

    return texts.select("text", "held_out", "run", "row").mapInArrow(count, "run bigint, first bigint, bucket int, k1 binary, c1 binary, k2 binary, c2 binary")


_MERGED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("levels", pa.list_(pa.int64())), ("run", pa.int64()), ("first", pa.int64()), ("l1", pa.binary()), ("l2", pa.binary()), ("chance", pa.float64())])


def _merged(counted: DataFrame) -> DataFrame:
    """Per bucket, by kind: 1 the words, their counts and the number of each level; 2 the same numbers of pairs;
    3 the segment of the filter; 0, for each piece, the filter's level of each of its words and pairs."""

    def merge(table: pa.Table) -> pa.Table:
        bucket, rows, held = table["bucket"][0].as_py(), [], {}
        for kind in (1, 2):
            blobs = table[f"k{kind}"].to_pylist()
            keys = np.concatenate([_unpack(k, _width(kind)) for k in blobs])
            counts = np.concatenate([np.frombuffer(c, "<u4") for c in table[f"c{kind}"].to_pylist()]).astype(np.int64)
            keys, back = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, counts)
            held[kind] = keys, total, back, np.cumsum([0, *(len(k) // _width(kind) for k in blobs)])
            keys, total = keys[total > 0], total[total > 0]
            row = {"kind": kind, "bucket": bucket, "total": int(total.sum()), "levels": np.bincount(level(total), minlength=LEVELS).tolist()}
            rows.append(row | ({"keys": _pack(keys, 8), "counts": total.astype("<i8").tobytes()} if kind == 1 else {}))
        bits = segment([(kind, keys[total > 0], total[total > 0]) for kind, (keys, total, _, _) in held.items()])
        rows.append({"kind": 3, "bucket": bucket, "keys": bits.tobytes(), "chance": chance(bits)})
        found = {kind: (probe(bits, keys, kind).astype(np.uint8)[back], ends) for kind, (keys, _, back, ends) in held.items()}
        for i, (run, first) in enumerate(zip(table["run"].to_pylist(), table["first"].to_pylist(), strict=True)):
            rows.append({"kind": 0, "bucket": bucket, "run": run, "first": first} | {f"l{kind}": lv[ends[i] : ends[i + 1]].tobytes() for kind, (lv, ends) in found.items()})
        tv.released()
        return pa.Table.from_pylist(rows, _MERGED)

    return counted.groupBy("bucket").applyInArrow(merge, "kind int, bucket int, keys binary, counts binary, total bigint, levels array<bigint>, run bigint, first bigint, l1 binary, l2 binary, chance double")


def segment(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The bits of a bucket's segment from (kind, keys, counts)."""
    parts = [(kind, keys, level(counts)) for kind, keys, counts in parts]
    size = -(-sum(int(lv.sum()) for _, _, lv in parts) * BITS // 64) * 64
    flags = np.zeros(size, np.uint8)
    for kind, keys, lv in parts:
        for j in range(1, int(lv.max(initial=0)) + 1):
            keys, lv = keys[lv >= j], lv[lv >= j]
            flags[places(keys ^ U64(kind), j, np.int64(size)).reshape(-1)] = 1
    return np.packbits(flags, bitorder="little")


def chance(bits: np.ndarray) -> float:
    """The chance that a segment holds a level of an n-gram that was never inserted."""
    return float((np.bitwise_count(bits).sum() / max(1, 8 * len(bits))) ** PROBES)


def probe(bits: np.ndarray, keys: np.ndarray, kind: int) -> np.ndarray:
    """The level of each key in its bucket's segment, 0 if it isn't held; probed level by level."""
    out = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys) if len(bits) else 0)
    key = (keys & _LOW48 if kind == 2 else keys) ^ U64(kind)
    for j in range(1, LEVELS):
        if not len(live):
            break
        some = key[live]
        for first, last in ((0, 2), (2, PROBES)):  # most of those that aren't held fall at the first probes
            spot = places(some, j, np.int64(len(bits) * 8), first, last)
            on = ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).all(axis=1)
            live, some = live[on], some[on]
        out[live] = j
    return out


@dataclass
class Model:
    """The filter's segments, which stay on the cluster, and the numbers of the corpus."""

    segments: DataFrame
    buckets: int
    n: int
    v: int
    mu: float
    low: float
    ghosts: float

    @property
    def size(self) -> float:
        """The denominator of p(w)."""
        return self.low + 0.1 * (self.v + 1)

    def levels(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        """The level of each of a few n-grams, 0 if it isn't held; segment by segment."""
        out, bucket = np.zeros(len(hashes), np.int64), _bucket(hashes, self.buckets)
        for row in self.segments.toLocalIterator():
            mine = np.flatnonzero(bucket == row["bucket"])
            out[mine] = probe(np.frombuffer(row["bits"], np.uint8), hashes[mine], kind)
        return out


def places(keys: np.ndarray, j: int, size: np.ndarray, first: int = 0, last: int = PROBES) -> np.ndarray:
    """The bits of level j of each key within segments of the given sizes."""
    h = tv.mix(keys + U64(j * int(tv.BASE) % (1 << 64)))
    step = (h >> U64(33)) | U64(1)
    size = size.astype(np.uint64)
    return np.stack([((h + U64(i) * step) % size).astype(np.int64) for i in range(first, last)], axis=1)


def strength(words: np.ndarray, pairs: int) -> float:
    """mu with sum over words of mu * log(1 + c / mu) = pairs; `words` has the number of words of each level."""
    c, lo, hi = LOW, 1e-3, 1e12
    for _ in range(200):
        mu = (lo * hi) ** 0.5
        lo, hi = (mu, hi) if (words * mu * np.log1p(c / mu)).sum() < pairs else (lo, mu)
    return float(np.clip((lo * hi) ** 0.5, 1e-3, 1e9))


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the rows of `texts` that aren't held out, and the merged counts, segments and answers, which stay on the cluster."""
    if "run" not in texts.columns:
        texts = _placed(texts.withColumn("held_out", F.lit(False)))
    size = texts.where("not held_out").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(1 << 24, max(16, -(-size // BUCKET_BYTES))))
    merged = staged(_merged(_counted(texts, buckets)), "ngram-counts")
    sums = {k: (np.array(levels, np.int64), int(total or 0)) for k, levels, total in merged.where("kind in (1, 2)").select("kind", "total", F.posexplode("levels").alias("j", "x")).groupBy("kind", "j").agg(F.sum("x").alias("x"), F.sum("total").alias("total")).groupBy("kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("levels"), F.min("total").alias("total")).collect()}
    none = (np.zeros(LEVELS, np.int64), 0)
    (words, n), (pairs, _) = sums.get(1, none), sums.get(2, none)
    v = int(words.sum())
    segments = merged.where("kind = 3")
    ghosts = v * float(segments.agg(F.avg("chance")).first()[0] or 0.0)
    return Model(segments.select("bucket", F.col("keys").alias("bits")), buckets, n, v, strength(words, int(pairs.sum())), float((words * LOW).sum()), ghosts), merged


def conditional(pair_level: np.ndarray, context_level: np.ndarray, word_level: np.ndarray, model: Model) -> np.ndarray:
    """p(w | v) from the levels held for vw, v and w."""
    most = HIGH[context_level]
    seen = np.minimum(LOW[pair_level], np.minimum(most, HIGH[word_level]))
    return (seen + model.mu * (LOW[word_level] + 0.1) / model.size) / (most + model.ghosts + model.mu)


def _word_counts(merged: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(keys, 8).view(np.int64)), pa.array(np.frombuffer(counts, "<i8"))], ["word", "count"])

    return merged.where("kind = 1").select("keys", "counts").mapInArrow(run, "word bigint, count bigint")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: int = 1_000_000) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), (fold(id_col, FOLDS) == 0).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = _placed(source)
    model, merged = train(texts)
    counts = _word_counts(merged)
    spread = counts.groupBy(level_of("count").alias("j")).agg(F.count("*").alias("n")).orderBy(F.desc("j")).collect()
    cut, held = 64, 0
    for j, n in spread:  # whole powers of two, from the most frequent words down
        if held + n > table:
            break
        cut, held = j, held + n
    top = counts.where(level_of("count") >= cut).toArrow()  # at most `table` words
    words, freq = top["word"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(words)
    shared = spark.sparkContext.broadcast((words[order], freq[order]))
    total, buckets = model.n + 0.1 * (model.v + 1), model.buckets
    plain_model = replace(model, segments=None)
    names = ["id", "held_out", "row", "n_tokens", "n_known", "base", "score", "rare"]

    def piece(texts: pa.Table, first: list[bytes], second: list[bytes]) -> pa.Table:
        known, freq = shared.value
        token, before, ends = tokens(texts["text"])
        text, count = np.repeat(np.arange(texts.num_rows), np.diff(ends)), texts.num_rows
        unique, back = np.unique(token, return_inverse=True)
        place = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
        common = known[place] == unique if len(known) else np.zeros(len(unique), bool)
        exact = np.where(common, np.log10((freq[place] if len(known) else 0) + 0.1) - np.log10(total), 0.0)
        base = np.bincount(text, exact[back], count)
        n_known = np.bincount(text, common[back], count).astype(np.int64)
        rare = np.flatnonzero(~common[back])
        # the model's own counts, all from the filter
        plain = answered(unique, first)
        context, at = np.unique(before, return_inverse=True)
        held = plain[np.searchsorted(unique, np.where(context == BEGIN, tv.END, context))]
        pairs, where = np.unique(pair(before, token), return_inverse=True)
        logs = np.log10(conditional(answered(pairs, second)[where], held[at], plain[back], plain_model))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, ends), pa.int32()), pa.array(token[rare].view(np.int64)))
        return pa.table([texts["id"], texts["held_out"], texts["row"], pa.array(np.diff(ends), pa.int64()), pa.array(n_known), pa.array(base), pa.array(np.bincount(text, logs, count)), lists], names)

    def answered(unique: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        """The levels of a piece's distinct n-grams from the buckets' answers."""
        out = np.empty(len(unique), np.uint8)
        out[_dealt(unique, buckets)[0]] = np.frombuffer(b"".join(blobs), np.uint8)
        return out

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.sort_by("row"), answers.sort_by([("first", "ascending"), ("bucket", "ascending")])
        firsts, begin = np.unique(answers["first"].to_numpy(), return_index=True)
        begin = [*begin.tolist(), answers.num_rows]
        rows = [*np.searchsorted(texts["row"].to_numpy(), firsts).tolist(), texts.num_rows]
        out = []
        for i in range(len(firsts)):
            mine = answers.slice(begin[i], begin[i + 1] - begin[i])
            out.append(piece(texts.slice(rows[i], rows[i + 1] - rows[i]), mine["l1"].to_pylist(), mine["l2"].to_pylist()))
        tv.released()
        return pa.concat_tables(out)

    kind = dict(docs.dtypes)[id_col]
    answers = merged.where("kind = 0").select("run", "first", "bucket", "l1", "l2")
    scored = texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(run, f"id {kind}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>")
    scored = staged(scored, "ngram-scored")
    shared.destroy()  # frees the words on the executors
    rest = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    found = rest.join(counts.where(level_of("count") < cut), "word", "left")
    part = F.col("tf") * (F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.1)) - F.log10(F.lit(total)))
    sums = found.groupBy("row").agg(F.sum(part).alias("more"), F.sum(F.when(F.col("count").isNotNull(), F.col("tf")).otherwise(0)).alias("seen"))
    out = scored.drop("rare").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def level_of(count: str) -> Column:
    """A coarse scale of counts, by powers of two."""
    return F.floor(F.log2(F.greatest(F.col(count), F.lit(1)).cast("double"))).cast("int")
