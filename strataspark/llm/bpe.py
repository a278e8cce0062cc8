"""BPE encoding and decoding with the contiguous rank array, after a public tokenizer file.

The texts of a batch are cut at special tokens, normalised (NFC, lower case) and laid side by side as
one array of code points. The split pattern's matches come from the classes of neighbouring code
points (`cuts`), so no Python code runs per word; an Arrow dictionary gives each distinct word of
the batch once. Distinct words are merged side by side (`merged`): words of one number of parts are
the rows of two arrays, the parts between their boundaries and the ranks of neighbouring parts. In
each row the least rank is found by a scan, its inner boundary is deleted, the two neighbouring ranks
are refreshed, and the row goes on among the rows of one part less. Words of over `LONG` bytes are
merged one by one with a heap of ranks (`merge_long`), as repeated scans would take the square of
their length.

Decoding takes the ids alone: each is looked up in the table of tokens, and the tokens are joined
with one space, as a file without a decoder asks for; the special tokens stay.

Defined results: null and empty texts have no ids and decode to an empty text; texts of any length
are encoded whole; rows that repeat are encoded alike; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: Bytes of text that are laid side by side, and of the longest word that is merged by scans.
BATCH, LONG = 3 << 20, 48
_NONE = np.int32(1 << 30)
# Fixed value: the split pattern that `cuts` works out; other patterns go through the regex module.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIGN, _LETTER, _NUMBER, _BLANK = range(4)
_TAILS = {1: "stmd", 2: ("re", "ve", "ll")}


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or another sign."""
    out = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, codes = "".join(map(chr, points)), np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[codes[m.start() : m.end()]] = kind
    return out


def cuts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of PATTERN begin in lower-case code points, and which code points belong to words.

    A run of letters, each number, and a run of signs are words. An apostrophe before s, t, m, d, re,
    ve or ll takes these letters along if no sign stands before it, as a run of signs would have
    taken it; the letters after them are a word of their own.
    """
    kind = classes()[codes]
    solid = kind != _BLANK
    begin = solid.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    n = len(codes)
    at = np.flatnonzero(codes[:-1] == ord("'")) if n > 1 else np.empty(0, np.int64)
    at = at[begin[at]]
    if len(at):
        one = codes[at + 1]
        two = np.where(at + 2 < n, codes[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in _TAILS[1]])
        long = np.zeros(len(at), bool)
        for a, b in _TAILS[2]:
            long |= (one == ord(a)) & (two == ord(b))
        for some, size in ((at[short], 2), (at[long], 3)):
            begin[some + 1] = False
            after = some + size
            after = after[after < n]
            begin[after] = solid[after]
    return np.flatnonzero(begin), solid


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return letters


class Tokenizer:
    """Reads a tokenizers file with a BPE model, word ends and a split pattern."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in (vocab | self.special).items()}
        # parts have numbers of their own: those of the bytes, of the bytes at a word's end, and of the merges' results
        letters = [byte_letters()[b] for b in range(256)]
        number: dict[str, int] = {}
        for part in [*letters, *(x + suffix for x in letters), *(x for a, b in pairs for x in (a, b, a + b))]:
            number.setdefault(part, len(number))
        self.parts = len(number)
        self.inner, self.final = (np.array([number[x + end] for x in letters], np.int32) for end in ("", suffix))
        self.id_of = np.array([vocab.get(part, -1) for part in number], np.int32)
        keys = np.array([number[a] * self.parts + number[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([number[a + b] for a, b in pairs], np.int32)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = None if pattern == PATTERN else regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # each id's token and decimal digits after a space; an id without a token has neither
        top = max(tokens, default=-1) + 1
        self.tokens = pa.array([(" " + tokens[i]).encode() if i in tokens else b"" for i in range(top)], pa.large_binary())
        self.digits = pa.array([f" {i}".encode() for i in range(top)], pa.large_binary())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of neighbouring parts."""
        if not len(self.pairs):
            return np.full(left.shape, _NONE)
        key = left.astype(np.int64) * self.parts + right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.ranks[place], _NONE)

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The parts of all words one after another, and the number of parts of each."""
        _, places, data = words.buffers()
        offsets = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(data, np.uint8)
        sizes = np.diff(offsets)
        rows: list[np.ndarray] = []  # words that are done, their parts and numbers of parts
        done: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(sizes > LONG):
            done.append(self.merge_long(data[offsets[i] : offsets[i + 1]]))
            rows.append(np.array([i]))
            counts[i] = len(done[-1])
        word, parts, near = np.empty(0, np.int64), np.empty((0, LONG + 1), np.int32), np.empty((0, LONG), np.int32)
        for size in range(LONG, 0, -1):
            new = np.flatnonzero(sizes == size)
            raw = data[offsets[new][:, None] + np.arange(size)]
            fresh = self.inner[raw]
            fresh[:, -1] = self.final[raw[:, -1]]
            word, parts = np.concatenate([word, new]), np.concatenate([parts[:, :size], fresh])
            near = np.concatenate([near[:, : size - 1], self.rank(fresh[:, :-1], fresh[:, 1:])])
            if not len(word):
                continue
            at = near.argmin(axis=1) if size > 1 else np.zeros(len(word), np.int64)
            every = np.arange(len(word))
            ends = near[every, at] == _NONE if size > 1 else np.ones(len(word), bool)
            rows.append(word[ends])
            done.append(parts[ends].reshape(-1))
            counts[word[ends]] = size
            go = ~ends
            word, parts, near, at = word[go], parts[go], near[go], at[go]
            every = np.arange(len(word))
            parts[every, at] = self.result[near[every, at]]
            keep = np.ones(parts.shape, bool)
            keep[every, at + 1] = False  # the inner boundary goes, and with it a part and a rank
            parts = parts[keep].reshape(len(word), size - 1)
            near = near[keep[:, 1:]].reshape(len(word), max(0, size - 2))
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < size - 2)
            near[left, at[left] - 1] = self.rank(parts[left, at[left] - 1], parts[left, at[left]])
            near[right, at[right]] = self.rank(parts[right, at[right]], parts[right, at[right] + 1])
        order = np.concatenate([np.empty(0, np.int64), *rows])
        flat = np.concatenate([np.empty(0, np.int32), *done])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(flat))], counts

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """The parts of a long word: the same merges in the same order, the next one from a heap of (rank, place)."""
        parts = self.inner[word].tolist()
        parts[-1] = int(self.final[word[-1]])
        last, live = len(parts), [True] * len(parts)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        ranks = self.rank(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(r, i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r != _NONE]
        heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            r = int(self.rank(np.array([parts[i]]), np.array([parts[j]]))[0])
            if r != _NONE:
                heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if not live[i] or j == last or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = int(self.result[r]), False, after[j]
            if after[i] < last:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([p for p, on in zip(parts, live, strict=True) if on], np.int32)

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, letter by letter as Unicode's simple rule has it; white space needs no change, as the pattern skips it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # a capital sigma is lowered without regard to its place
                text = text.replace("Σ", "σ")
        return text.lower()

    def _pieces(self, texts: list[str | None]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        """Normalised pieces, the text of each, and (piece, id) for the special tokens, which are empty pieces."""
        pieces, owner, special = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.cut is None or not self.cut.search(text):
                pieces.append(self.normal(text))
                owner.append(i)
                continue
            for piece in self.cut.split(text):
                if piece in self.special:
                    special.append((len(pieces), self.special[piece]))
                    piece = ""
                pieces.append(self.normal(piece))
                owner.append(i)
        return pieces, owner, special

    def _words(self, pieces: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the pieces, as bytes, and the number of words of each piece."""
        if self.words is not None:
            found = [self.words.findall(p) for p in pieces]
            return pa.array([w.encode() for f in found for w in f], pa.large_binary()), np.array([len(f) for f in found], np.int64)
        whole = "\n".join(pieces)
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        if whole.isascii():
            codes = np.frombuffer(whole.encode(), np.uint8)
            start, solid = cuts(codes)
            data, ends = codes[solid].tobytes(), None
        else:
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            start, solid = cuts(codes)
            kept = codes[solid]
            data = kept.tobytes().decode("utf-32-le").encode()
            ends = np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000))
        place = np.cumsum(solid)[start] - 1  # among the code points that belong to words
        offsets = np.empty(len(start) + 1, np.int64)
        offsets[:-1] = place if ends is None else np.where(place > 0, ends[place - 1], 0)
        offsets[-1] = len(data)
        counts = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and offsets: text i has ids[offsets[i]:offsets[i+1]]."""
        pieces, owner, special = self._pieces(texts)
        if not pieces:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        words, counts = self._words(pieces)
        found = words.dictionary_encode()
        flat, sizes = self.merged(found.dictionary)
        flat = self.id_of[flat]
        if len(flat) and flat.min() < 0:  # parts that the vocabulary doesn't have
            held = np.concatenate([[0], np.cumsum(flat >= 0)])
            sizes = np.diff(held[np.concatenate([[0], np.cumsum(sizes)])])
            flat = flat[flat >= 0]
        at = found.indices.to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        many = sizes[at] if len(at) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])  # of the words, in ids
        out = flat[np.repeat(starts[at] - ends[:-1], many) + np.arange(ends[-1])] if len(at) else flat
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]  # of the pieces
        if special:
            where = np.array([p for p, _ in special])
            out = np.insert(out, bounds[where], np.array([i for _, i in special], np.int32))
            bounds = bounds + np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(pieces)))])
        return out, bounds[np.searchsorted(np.array(owner), np.arange(len(texts) + 1))]

    @staticmethod
    def _spelled(table: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        """For each run of ids their entries in the table, joined; every entry begins with a space, the first of which goes."""
        taken = table.take(pa.array(ids))
        if not len(taken):
            return [memoryview(b"")] * (len(offsets) - 1)
        _, places, data = taken.buffers()
        ends = np.frombuffer(places, np.int64)[: len(taken) + 1][offsets].tolist()
        data = memoryview(data) if data is not None else memoryview(b"")
        return [data[min(a + 1, b) : b] for a, b in zip(ends, ends[1:], strict=False)]

    def written(self, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        """The decimal ids of each run, with one space between."""
        return self._spelled(self.digits, ids, offsets)

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        """The text of each run of ids, in UTF-8; ids without a token have no text."""
        known = (ids >= 0) & (ids < len(self.tokens))
        if not known.all():
            offsets = np.concatenate([[0], np.cumsum(known)])[offsets]
            ids = ids[known]
        return self._spelled(self.tokens, ids, offsets)

    def encode(self, text: str | None) -> list[int]:
        return self.ids([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return bytes(self.decoded(np.array(ids, np.int64), np.array([0, len(ids)]))[0]).decode()


_loaded: dict[str, Tokenizer] = {}


def _of(source: str) -> Tokenizer:
    """One tokenizer for each worker, whose words stay known from task to task."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(source)
    return _loaded[key]


def _source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256. `path` is the tokenizer file, read on the driver (2 MB)."""
    source = docs.sparkSession.sparkContext.broadcast(_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(source.value)
        for batch in tv.chunks(batches, "text", BATCH):
            ids, offsets = bpe.ids(batch.column("text").to_pylist())
            hashes = [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (bpe.written(ids, offsets), bpe.decoded(ids, offsets))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), *hashes], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return _text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the ids and the text that they decode to."""
    source = docs.sparkSession.sparkContext.broadcast(_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(source.value)
        for batch in tv.chunks(batches, "text", BATCH):
            ids, offsets = bpe.ids(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            texts = pa.array([bytes(x) for x in bpe.decoded(ids, offsets)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), lists, texts], [id_col, "n_tokens", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return _text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded string")
