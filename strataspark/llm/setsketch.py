"""Near duplicates by SetSketch registers, banding, joint likelihood estimates and an exact check.

A document's set holds the hashes of its word shingles. Register i is the truncated, exponentially
spaced minimum floor(1 - log_b(min Exp_i)) over the set, kept in [0, q + 1], so the sketch of a
union is the larger of both registers. Documents whose registers agree in any band are candidates.
For those the Jaccard similarity is estimated from the counts of larger, smaller and equal
registers by maximum likelihood, with the known set sizes; what could reach the threshold is
checked on the full sets.

Work stays linear in the size of a bucket: equal sets are one node, members are first compared with
the leader of their bucket only, links are contracted, and just the members of buckets that still
hold several components are compared with each other, in blocks.

Defined results: null, empty and blank texts have no shingles, n_shingles 0, and are linked with
nothing; texts of fewer words than a shingle have one shingle, their whole sequence; repeated rows
are linked like other equal texts; rows with a null id take part, and the id of a component is its
smallest id that isn't null (null if there is none). An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import staged

U64 = np.uint64
#: Base and rate of the registers, and their largest value.
B, RATE, TOP = 1.001, 20.0, 65535
#: Members of a block of a bucket that are compared with each other at once.
BLOCK = 256
#: Standard errors that an estimate may fall short of the threshold before a pair is left unchecked.
SIGMAS = 5.0
SKETCHED = "id bigint, n_shingles bigint, node binary, registers binary"


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(77))
    return rng.integers(0, 1 << 63, m, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64) * U64(2) + U64(1)


def _sets(column: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    hashes, ends = tv.shingles(*tv.words(column), k)
    sets = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return sets, hashes, ends


def registers(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """The m registers of each non-empty run of `hashes` that begins at one of `starts`, as rows of uint16."""
    low = np.empty((m, len(starts)), np.uint64)
    for i, (xor, times) in enumerate(zip(*_seeds(m), strict=True)):
        x = (hashes ^ xor) * times
        x ^= x >> U64(32)
        low[i] = np.minimum.reduceat(x, starts)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    value = np.maximum(value, 1e-300)
    return np.clip(np.floor(1.0 - np.log(value) / np.log(B)), 0, TOP).astype(np.uint16).T.copy()


def jaccard_estimate(more: np.ndarray, less: np.ndarray, same: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity, from the registers where the first sketch is larger, smaller or equal and the set sizes."""
    u = nu / (nu + nv)
    v = 1.0 - u
    p = lambda x: -np.log1p(-np.maximum(x, 0.0) * (B - 1.0) / B) / np.log(B)
    log = lambda x: np.log(np.maximum(x, 1e-12))

    def likelihood(j: np.ndarray) -> np.ndarray:
        pm, pl = p(u - v * j), p(v - u * j)
        return more * log(pm) + less * log(pl) + same * log(1.0 - pm - pl)

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(32):  # the likelihood is concave
        a, b = lo + (hi - lo) / 3.0, hi - (hi - lo) / 3.0
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2.0


def _could_link(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray, percent: int) -> np.ndarray:
    m, t = ru.shape[1], percent / 100.0
    fits = 100 * np.minimum(nu, nv) >= percent * np.maximum(nu, nv)
    keep = np.zeros(len(nu), bool)
    if fits.any():
        # the share of equal registers is nearly the similarity; what is far off needs no likelihood
        near = np.flatnonzero(fits)
        near = near[(ru[near] == rv[near]).sum(1) >= m * t - (SIGMAS + 1.0) * np.sqrt(m * t * (1.0 - t))]
        ru, rv = ru[near], rv[near]
        more, less = (ru > rv).sum(1), (ru < rv).sum(1)
        got = jaccard_estimate(more, less, m - more - less, nu[near].astype(float), nv[near].astype(float))
        keep[near] = got >= t - SIGMAS * np.sqrt(t * (1.0 - t) / m)
    return keep


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, m)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, m: int) -> DataFrame:
    """id, size of the set, node (a 128-bit hash of the whole set; null if empty) and registers, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text"):
            sets, hashes, ends = _sets(batch.column("text"), k)
            full = np.flatnonzero(np.diff(ends))
            regs: list[bytes | None] = [None] * len(sets)
            if len(full):
                for i, row in zip(full, registers(hashes, ends[full], m), strict=True):
                    regs[i] = row.tobytes()
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(regs, pa.binary())], ["id", "n_shingles", "node", "registers"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCHED)


def _band_keys(nodes: DataFrame, m: int, rows: int) -> DataFrame:
    bands = m // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column("registers"), m)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), regs.shape[:2]).copy()
            for r in range(rows):
                key = tv.mix(key * tv.BASE + regs[:, :, r])
            at = np.repeat(np.arange(batch.num_rows), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), batch.column("node").take(pa.array(at))], ["key", "band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "key bigint, band int, node binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, m: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity could reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _could_link(_matrix(batch.column("ra"), m), _matrix(batch.column("rb"), m), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("registers").alias(f"r{side}")), side)
    sized = pairs.where((F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent))
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a binary, b binary")


def _found(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, what: str) -> DataFrame:
    """node and its text or (`what`: hashes) the sorted hashes of its set, for the distinct nodes of `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text"):  # rows that share an id may have other texts
            blobs = [s.tobytes() for s in _sets(batch.column("text"), k)[0]]
            keep = [hashlib.blake2b(b, digest_size=16).digest() == n for b, n in zip(blobs, batch.column("node").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text") if what == "text" else pa.array(blobs, pa.binary())], ["node", what]).filter(pa.array(keep, pa.bool_()))

    place = wanted.join(nodes.select("node", F.col("id").alias("at")), "node")
    return docs.join(place, F.col("id").eqNullSafe(F.col("at"))).select("node", "text").mapInArrow(run, "node binary, text string" if what == "text" else "node binary, hashes binary")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "ta"):
            left, right = _sets(batch.column("ta"), k)[0], _sets(batch.column("tb"), k)[0]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - common
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * total))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = staged(_found(wanted, nodes, docs, k, "text"), "near-texts")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}")), side)
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame | None:
    """(node, label) of each node but the smallest of its component; label is that smallest node. None: no edges.

    Each round hooks every node to its smallest neighbour, flattens the trees by pointer jumping and
    contracts the edges, so the rounds grow with the logarithm of a component's size.
    """
    mapping = None
    edges = staged(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "cc-edges")
    while not edges.isEmpty():
        parent = staged(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "cc-parent")
        while True:
            up = parent.select(F.col("hi").alias("lo"), F.col("lo").alias("above"))
            jumped = staged(parent.join(up, "lo", "left").select("hi", F.coalesce("above", "lo").alias("lo"), F.col("above").isNotNull().alias("moved")), "cc-jump")
            parent = jumped.select("hi", "lo")
            if jumped.where("moved").isEmpty():
                break
        named = parent.select(F.col("hi").alias("label"), F.col("lo").alias("root"))
        fresh = parent.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        mapping = fresh if mapping is None else mapping.join(named, "label", "left").select("node", F.coalesce("root", "label").alias("label")).unionByName(fresh)
        for side in ("hi", "lo"):
            edges = edges.join(parent.select(F.col("hi").alias(side), F.col("lo").alias("root")), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        edges = staged(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct(), "cc-edges")
    return mapping


def _labelled(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The members of buckets that still hold several components, each with its label."""
    mapping = None
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        mapping = components(found)
    if mapping is None:
        named = members.withColumn("label", F.col("node"))
    else:
        named = members.join(staged(mapping, "near-labels"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = staged(named, "near-members")
    split = named.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("size")).where("first <> last").drop("first", "last")
    return named.join(split, "key")


def _joined_in_blocks(open_members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, m: int, rows: int, percent: int) -> DataFrame:
    """Links (a, b) between different components within buckets, checked on the full sets.

    Blocks of members meet, never a whole bucket, and the largest component's blocks don't meet each
    other, so few members outside of it cost rows in proportion to the bucket. A pair is looked at in the first band that it
    shares only. Within a block, pairs that earlier links have joined are passed over, so a block
    gives fewer links than it has members, and nothing is sent for pairs that aren't links.
    """

    def links_of(band: int, same_side: bool, node: list[bytes], label: list[bytes], n: np.ndarray, regs: np.ndarray, side: np.ndarray, sets: pa.Array) -> list[tuple[bytes, bytes]]:
        i, j = np.triu_indices(len(n), 1)
        names = {x: t for t, x in enumerate(dict.fromkeys(label))}
        codes = np.array([names[x] for x in label])
        keep = codes[i] != codes[j]
        if not same_side:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        root = list(range(len(names)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        held: dict[int, np.ndarray] = {}
        for at in range(0, len(i), 16384):
            x, y = i[at : at + 16384], j[at : at + 16384]
            ok = _could_link(regs[x], regs[y], n[x], n[y], percent)
            x, y = x[ok], y[ok]
            if band:
                agree = (regs[x, : band * rows] == regs[y, : band * rows]).reshape(-1, band, rows).all(axis=2).any(axis=1)
                x, y = x[~agree], y[~agree]
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                u, v = top(codes[p]), top(codes[q])
                if u == v:
                    continue
                for t in (p, q):
                    if t not in held:
                        held[t] = np.frombuffer(sets[t].as_buffer(), np.uint64)
                common = len(np.intersect1d(held[p], held[q], assume_unique=True))
                if 100 * common >= percent * (len(held[p]) + len(held[q]) - common):
                    root[max(u, v)] = min(u, v)
                    out.append((min(node[p], node[q]), max(node[p], node[q])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: bool) -> tuple[list[tuple[bytes, bytes]], list[pa.RecordBatch]]:
            """The links of the groups that have come in whole, and the rows of the last one."""
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table["key"].to_numpy(), table["bi"].to_numpy(), table["bj"].to_numpy()], 1)
            bounds = np.concatenate([[0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1, [len(key)]])
            todo = len(bounds) - 1 if whole else len(bounds) - 2
            out: list[tuple[bytes, bytes]] = []
            for a, b in zip(bounds[:todo], bounds[1 : todo + 1], strict=True):
                part = table.slice(a, b - a)
                out += links_of(part["band"][0].as_py(), key[a, 1] == key[a, 2], part["node"].to_pylist(), part["label"].to_pylist(), part["n_shingles"].to_numpy(), _matrix(part["registers"], m), part["side"].to_numpy(), part["hashes"].combine_chunks())
            return out, table.slice(bounds[max(0, todo)]).to_batches()

        def emit(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out, held = flush(False)
                yield emit(out)
        if held:
            yield emit(flush(True)[0])
        held.clear()
        tv.released()

    sets = staged(_found(open_members.select("node").distinct(), nodes, docs, k, "hashes").dropDuplicates(["node"]), "near-sets")
    # of a bucket larger than a block, the largest component's members need no blocks of their own kind beside them
    large = open_members.where(F.col("size") > BLOCK).groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = large.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top")).select("key", F.col("top.n").alias("inside"), F.col("top.label").alias("main"))
    whole = open_members.join(nodes.select("node", "n_shingles", "registers"), "node").join(sets, "node").join(largest, "key", "left")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    inside = F.coalesce("inside", F.lit(0))
    parts = whole.withColumn("mine", F.coalesce(F.col("label") == F.col("main"), F.lit(False))).withColumn("first", blocks(inside)).withColumn("rest", blocks(F.col("size") - inside))
    spot = F.xxhash64("node")
    parts = parts.withColumn("side", F.when(F.col("mine"), F.pmod(spot, F.col("first"))).otherwise(F.col("first") + F.pmod(spot, F.col("rest"))).cast("int"))
    # sides below `first` hold the largest component: they meet the other sides only
    dealt = parts.withColumn("other", F.explode(F.sequence(F.when(F.col("mine"), F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)))
    dealt = dealt.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other"))
    count = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(count, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return ordered.select("key", "band", "bi", "bj", "side", "node", "label", "n_shingles", "registers", "hashes").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, m: int = 120, rows: int = 5) -> DataFrame:
    """Per row: the id, n_shingles, component_id and kept (id = component_id).

    Links: 100 * intersection >= percent * union of the shingle sets. With m / rows bands of `rows`
    registers, a pair at similarity s meets in some band with chance 1 - (1 - s**rows)**(m/rows):
    1 - 8e-7 at 0.85 for the defaults, and more above.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rowwise = staged(sketches(source, "id", "text", shingle, m), "near-sketches")
    nodes = staged(rowwise.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "near-nodes")
    bands = _band_keys(nodes, m, rows)
    buckets = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    members = staged(bands.join(buckets, "key"), "near-buckets")

    tested: list[DataFrame] = []
    links: list[DataFrame] = []
    open_members = members
    for leader in ("leader", "last"):
        pairs = open_members.where(F.col("node") != F.col(leader)).select(F.least("node", leader).alias("a"), F.greatest("node", leader).alias("b")).distinct()
        for seen in tested:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = staged(_estimated(pairs, nodes, m, percent), "near-pairs")
        if not pairs.isEmpty():
            tested.append(pairs)
            links.append(staged(_verified(pairs, nodes, source, shingle, percent), "near-links"))
        open_members = staged(_labelled(members, links), "near-open")
        if open_members.isEmpty():
            break
    else:
        links.append(staged(_joined_in_blocks(open_members, nodes, source, shingle, m, rows, percent), "near-links"))

    mapping = None
    if links:
        found = links[0]
        for more in links[1:]:
            found = found.unionByName(more)
        mapping = components(found)
    rowwise = rowwise.select("id", "n_shingles", "node")
    named = rowwise.withColumn("label", F.col("node")) if mapping is None else rowwise.join(mapping, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = staged(named, "near-named")
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    out = named.join(least, "label", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of `docs` with one document of each group of near duplicates; of repeated rows one stays too."""
    kept = near_duplicates(docs, id_col, text_col, **how).where("kept").select(F.col(id_col).alias("__kept")).distinct()
    left = docs.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")
    return left.dropDuplicates([id_col, text_col])
