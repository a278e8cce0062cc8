"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all texts are unlabelled. A linear classifier in numpy over
words and runs of five bytes minimises the class-prior-corrected risk
    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))
with the logistic loss; where the second part falls below nought, the step goes back along its
gradient, so the classifier can't fit the unlabelled texts as all negative. The class prior is the
share of toxic rows among the labels of the training folds, one standard error up:
with a class prior that is too small, texts with clear evidence count as negative. The score is the classifier's chance.

Features are those that positives have clearly more often than all texts of the training folds: the
positives' features are counted on the cluster, and so are their counts among all training texts.
The weights are fitted on a bounded sample (`positives`, `unlabelled`: the texts with the least hash
of their id), of which the driver holds the numbers of the chosen features alone; every text is
scored whole, in one pass without a shuffle. Texts of any length are read in pieces.

Defined results: null and empty texts get the score of a text without evidence, which is below the
class prior and never over it; rows that repeat an id are scored one by one, and of labels that
repeat an id any toxic one counts; a null id counts as empty text in the fold; ties in the order of
ids go by the text; without any toxic label, or without any feature that tells, every score is the
class prior, at most 0.49. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import fold, staged

FOLDS, GRAM, SLOTS = 5, 5, 1 << 20
#: Positives that must have a feature, and the excess of its log-likelihood ratio over the log of the number of features tried.
LEAST, MARGIN = 3, 2.0
#: The greatest score of a text without evidence.
NO_EVIDENCE = 0.49
#: Texts whose features are worked out at a time.
TEXTS = 256


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text) of the distinct features of each text, for a few texts at a time. Runs of bytes have other hashes than words."""
    for at in range(0, len(column), TEXTS):
        some = column.slice(at, TEXTS)
        hashes, owner = [], []
        for kind, (found, offsets) in enumerate((tv.words(some), tv.grams(some, GRAM))):
            hashes.append(found if kind == 0 else tv.mix(found))
            owner.append(np.repeat(np.arange(at, at + len(some)), np.diff(offsets)))
        yield np.concatenate(hashes), np.concatenate(owner)


def _slots(keys: np.ndarray) -> np.ndarray:
    slots = np.zeros(SLOTS, bool)
    slots[keys & np.uint64(SLOTS - 1)] = True
    return slots


@dataclass
class Features:
    """Sorted hashes of the features that take part; `slots` marks where they may lie."""

    keys: np.ndarray
    slots: np.ndarray

    def of(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of a feature, text): once for each feature that a text has."""
        for hashes, text in features(column):
            near = np.flatnonzero(self.slots[hashes & np.uint64(SLOTS - 1)])
            if not len(near) or not len(self.keys):
                continue
            place = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
            hit = self.keys[place] == hashes[near]
            pair = np.unique(text[near[hit]] * len(self.keys) + place[hit])
            yield pair % len(self.keys), pair // len(self.keys)


@dataclass
class Classifier:
    """Weights of the features and a bias."""

    features: Features
    weights: np.ndarray
    bias: float

    def chance(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for place, text in self.features.of(column):
            out += np.bincount(text, self.weights[place], len(column))
        return _sigmoid(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float, size: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by non-negative PU risk, from (feature, text, number of texts) of either side."""
    (ip, rp, n_pos), (iu, ru, n_unl) = positive, unlabelled
    # a text without evidence is no likelier toxic than any text, and not predicted toxic
    most = float(np.log(min(prior, NO_EVIDENCE) / (1 - min(prior, NO_EVIDENCE))))
    w, bias = np.zeros(size), most
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        zp = np.bincount(rp, w[ip], n_pos) + bias
        zu = np.bincount(ru, w[iu], n_unl) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_pos, gp_neg, gu_neg = -prior * _sigmoid(-zp) / n_pos, -prior * _sigmoid(zp) / n_pos, _sigmoid(zu) / n_unl
        dp, du = (gp_pos + gp_neg, gu_neg) if negative >= 0 else (-gp_neg, -gu_neg)
        grad = np.append(np.bincount(ip, dp[rp], size) + np.bincount(iu, du[ru], size) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        bias = min(bias, most)
    return w, float(bias)


def chosen(df_p: np.ndarray, n_pos: int, df_u: np.ndarray, n_unl: int, prior: float) -> np.ndarray:
    """Places of the features that tell, from the numbers of positive and of all training texts with each."""
    p, u = df_p / max(1, n_pos), (df_u + 0.5) / (n_unl + 1)
    lift = np.maximum(p / u, 1e-9)
    # evidence against chance, as a log-likelihood ratio that must outweigh the number of features tried
    ratio = df_p * np.log(lift) - (df_p - df_p / lift)
    # and at least half of the texts with the feature are toxic, going by the prior
    return np.flatnonzero((lift > 1) & (ratio >= np.log(max(2, len(df_p))) + MARGIN) & (prior * lift >= 0.5))


def _counts(texts: DataFrame, known: Features | None = None) -> DataFrame:
    """feature, count: the number of texts with each feature, or with each of the known ones."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, None if shared.value is None else np.zeros(len(shared.value.keys), np.int64)
        for batch in tv.chunks(batches, "text", 4 << 20):
            if own is not None:
                for place, _ in own.of(batch.column("text")):
                    total += np.bincount(place, minlength=len(total))
                continue
            held = []
            for hashes, text in features(batch.column("text")):
                order = np.lexsort((text, hashes))
                h, t = hashes[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                held.append(h[new])
            keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "count"])
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own.keys[some].view(np.int64)), pa.array(total[some])], ["feature", "count"])

    return texts.select("text").mapInArrow(run, "feature bigint, count bigint").groupBy("feature").agg(F.sum("count").alias("count"))


def _held(texts: DataFrame, known: Features) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """For each part of the sample the places of known features, the text of each and the number of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text", 4 << 20):
            found = [(np.empty(0, np.int64),) * 2, *shared.value.of(batch.column("text"))]
            place, text = (np.concatenate(x) for x in zip(*found, strict=True))
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("key"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(place.astype(np.int32)))], ["part", "key", "places"])

    table = texts.mapInArrow(run, "part string, key binary, places array<int>").toArrow()
    table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")]))  # sums don't depend on the order of rows
    out = {}
    for part in "pu":
        lists = table.filter(pc.equal(table["part"], part))["places"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        out[part] = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), len(lists)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 4000, unlabelled: int = 12000) -> tuple[Classifier | None, float]:
    """The classifier (none without a toxic label) and the class prior; only rows of the training folds take part."""
    known = labels.where(fold(id_col, FOLDS) != 0).where(F.col(label_col).isNotNull())
    share, rated = known.agg(F.avg(F.col(label_col).cast("double")), F.count("*")).first()
    if not share:
        return None, 0.0
    prior = min(max(share + (share * (1 - share) / rated) ** 0.5, 1e-6), 0.99)
    toxic = known.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id")).limit(positives).withColumn("part", F.lit("p"))
    texts = docs.where(fold(id_col, FOLDS) != 0).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    others = texts.select("id").distinct().orderBy(F.xxhash64("id", F.lit(1))).limit(unlabelled).withColumn("part", F.lit("u"))
    wanted = F.broadcast(toxic.unionByName(others))  # at most positives + unlabelled ids
    sample = staged(texts.join(wanted, "id").select("part", "text").distinct().withColumn("key", F.unhex(F.sha2("text", 256))), "toxicity-sample")
    n_pos, n_unl = sample.where("part = 'p'").count(), texts.count()
    if not n_pos:
        return None, prior
    # candidates: features of several positives; of the texts they are counted in, none is left out
    found = _counts(sample.where("part = 'p'")).where(F.col("count") >= LEAST).toArrow()
    keys, df_p = found["feature"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(keys)
    keys, df_p = keys[order], df_p[order]
    among = _counts(texts, Features(keys, _slots(keys))).toArrow()
    df_u = np.zeros(len(keys), np.int64)
    df_u[np.searchsorted(keys, among["feature"].to_numpy().view(np.uint64))] = among["count"].to_numpy()
    keys = keys[chosen(df_p, n_pos, df_u, n_unl, prior)]
    if not len(keys):
        return None, prior
    taken = Features(keys, _slots(keys))
    parts = _held(sample, taken)
    weights, bias = fit(parts["p"], parts["u"], prior, len(keys))
    return Classifier(taken, weights, bias), prior


def probability(model: Classifier | None, prior: float, column: pa.Array) -> np.ndarray:
    return np.full(len(column), min(prior, NO_EVIDENCE)) if model is None else model.chance(column)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> DataFrame:
    """Per row: id, held_out, score and predicted. `positives` and `unlabelled` bound the texts of the fit."""
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, **bounds))
    source = docs.select(F.col(id_col).alias("id"), (fold(id_col, FOLDS) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text"):
            value = probability(*fitted.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> DataFrame:
    """The rows of `docs`, with all columns, whose text isn't predicted toxic."""
    fitted = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, text_col):
            yield batch.filter(pa.array(probability(*fitted.value, batch.column(text_col)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
