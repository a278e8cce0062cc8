"""Vectorised tokens: whole Arrow string columns become arrays of 64-bit word hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, after A-Z became a-z. As all separators are
ASCII, working on UTF-8 bytes gives the same words as working on characters. The hash of a word is
a polynomial over a table of random 64-bit numbers, got from prefix sums, so no Python code runs
per word. Buffers are cut at separators into pieces of about `PIECE` bytes, which bounds memory for
texts of any length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_bytes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
SPACE = np.isin(_bytes, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER] | U64(1)
END = U64(0x6A09E667F3BCC909)  # the end token
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, 2 * PIECE)
        for name, base in (("up", BASE), ("down", INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[name] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _piece(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of `buf`; a word ends at each of `breaks` too."""
    n = len(buf)
    up, down = _power(n)
    solid = ~SPACE[buf]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(VALUE[buf] * up[:n], out=total[1:])
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, mix((total[ends] - total[starts]) * down[starts])


def as_large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_binary array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    return column.cast(pa.large_binary())


def words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and offsets: text i has hashes[offsets[i]:offsets[i+1]]."""
    column = as_large(column)
    count = len(column)
    if not count:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + count + 1]
    if data is None or offs[-1] == offs[0]:
        return np.empty(0, np.uint64), np.zeros(count + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    starts, hashes, at, n = [], [], 0, len(buf)
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not SPACE[buf[to - 1]]:  # the piece must not end inside a word
            there = np.flatnonzero(SPACE[buf[to : to + 4096]])
            mark = offs[np.searchsorted(offs, to)]
            to = min(to + (int(there[0]) + 1 if len(there) else min(4096, n - to)), int(mark) if mark > to else n)
            if to == mark:
                break
        lo, hi = np.searchsorted(offs, [at, to])
        s, h = _piece(buf[at:to], offs[lo:hi] - at)
        starts.append(s + at)
        hashes.append(h)
        at = to
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, offs).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within each text; a text of 1 to k-1 words has one, of all its words."""
    counts = np.diff(offsets)
    out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(out)]).astype(np.int64)
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), ends
    rolled = np.full(n, U64(k), np.uint64)
    for j in range(k):
        rolled[: n - j] = mix(rolled[: n - j] * BASE + hashes[j:]) if j < n else rolled[:0]
    begin = np.repeat(offsets[:-1] - ends[:-1], out) + np.arange(ends[-1])
    result = rolled[np.minimum(begin, n - 1)]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.array([U64(counts[i]) + U64(1 << 40)], np.uint64)
        for w in hashes[offsets[i] : offsets[i + 1]]:
            x = mix(x * BASE + w)
        result[ends[i]] = x[0]
    return result, ends


def released() -> None:
    """Gives memory that this worker has freed back to the system: workers live on between tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of text or one row; at the end, freed memory goes back."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(as_large(batch.column(column)).buffers()[1], np.int64)[: batch.num_rows + 1]) if batch.num_rows else []
        at, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(size)
        if batch.num_rows > at:
            yield batch.slice(at)
    released()


def grams(column: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` bytes inside words, and the offsets of the texts; A-Z count as a-z."""
    column = as_large(column)
    count = len(column)
    _, offs, data = column.buffers() if count else (None, None, None)
    if data is None:
        return np.empty(0, np.uint64), np.zeros(count + 1, np.int64)
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + count + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    found, places, at, n = [], [], 0, len(buf)
    while at < n:
        to = min(n, at + PIECE)
        piece = buf[at : min(n, to + size - 1)]
        if len(piece) < size:
            break
        up, down = _power(len(piece))
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(VALUE[piece] * up[: len(piece)], out=total[1:])
        bad = np.zeros(len(piece) + 1, np.int32)
        np.cumsum(SPACE[piece], out=bad[1:])
        ok = bad[size:] == bad[:-size]
        lo, hi = np.searchsorted(offs, [at + 1, at + len(piece)])
        for b in offs[lo:hi] - at:  # a run must not reach over the end of a text
            ok[max(0, b - size + 1) : b] = False
        i = np.flatnonzero(ok)
        found.append(mix((total[i + size] - total[i]) * down[i]))
        places.append(i + at)
        at = to
    if not found:
        return np.empty(0, np.uint64), np.zeros(count + 1, np.int64)
    places = np.concatenate(places)
    return np.concatenate(found), np.searchsorted(places, offs).astype(np.int64)
