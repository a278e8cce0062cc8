"""Ogg media columns: pages with checksums, packets by lacing values, logical streams, granule positions.

`mux` writes packets into two logical streams, turn by turn, as an Ogg file; `demux` reads any Ogg
file: it checks every page's checksum and sequence number, puts packets together from lacing values
over page ends, and parts the streams by serial number. The granule position of a page is the time of
the last packet that ends on it. The packets before it follow backwards from there by what each lasts
(`lasting`, given the stream's first packet); without that they share the time since the page before
evenly by size.

A text is stored as 8-bit samples of `RATE` Hz: its UTF-8 bytes, filled with spaces to a positive
multiple of 192, are packets of 192 samples. Packet i goes to stream i mod 2, and each stream's
granule position counts the samples of the payload up to the end of the packet, so a packet moves its
stream on by 384. Reading derives every packet's time from the granule positions alone and sorts the
packets of both streams by it; a gap or two packets of one time raise an error.

Defined results: null counts as empty text, whose payload is one packet of spaces; equal texts give
equal bytes, as serial numbers come from the payload; rows that repeat an id are handled one by one;
extra columns are ignored; texts of any length are stored whole, one at a time in memory; an empty
table gives an empty result. A page that fails its checksum or a gap in the sequence raises an error
in `demux`, and is reported in `Media.errors` with strict=False.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

UNIT, RATE, STREAMS = 192, 8000, 2
#: Packets of a stream on one page.
PAGE_PACKETS = 64
HEAD = b"\x7fPCM8\x00\x01"
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_NO_TIME = (1 << 64) - 1


def checksum(data: bytes) -> int:
    """The page checksum: CRC-32 by polynomial 0x04C11DB7 from nought, most significant bit first.

    That is the mirror image of zlib's over mirrored bytes, without its two inversions.
    """
    mirrored = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Packet:
    serial: int
    data: bytes
    granule: int
    page: int


@dataclass
class Media:
    """What was read: packets in the order in which they end, pages, serials and errors."""

    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    serials: list[int] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def stream(self, serial: int) -> list[Packet]:
        return [p for p in self.packets if p.serial == serial]


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


class _Writer:
    """One logical stream; packets that don't fit a page's 255 lacing values go on in the next."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0
        self.lacing, self.body, self.granule, self.packets = bytearray(), bytearray(), _NO_TIME, 0
        self.continued = False

    def flush(self, flags: int = 0, goes_on: bool = False) -> bytes:
        flags |= (CONTINUED if self.continued else 0) | (FIRST if self.sequence == 0 else 0)
        out = page(self.serial, self.sequence, self.granule, flags, bytes(self.lacing), bytes(self.body))
        self.sequence += 1
        self.lacing, self.body, self.granule, self.packets = bytearray(), bytearray(), _NO_TIME, 0
        self.continued = goes_on
        return out

    def add(self, data: bytes, granule: int) -> bytes:
        """The pages that fill up while the packet is added."""
        out, at = b"", 0
        lacing = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        while lacing:
            if len(self.lacing) == 255:
                out += self.flush(goes_on=at > 0)
            take = lacing[: 255 - len(self.lacing)]
            size = sum(take)
            self.lacing += take
            self.body += data[at : at + size]
            at, lacing = at + size, lacing[len(take) :]
        self.granule = granule
        self.packets += 1
        return out


def mux(streams: dict[int, list[tuple[bytes, int]]], most: int = PAGE_PACKETS) -> bytes:
    """An Ogg file of logical streams: serial to (packet, granule position after it). The first packet has a page of its own."""
    writers = {s: _Writer(s) for s in streams}
    out = []
    for s, packets in streams.items():
        if packets:
            out.append(writers[s].add(*packets[0]))
        out.append(writers[s].flush(LAST if len(packets) < 2 else 0))
    at = dict.fromkeys(streams, 1)
    while any(at[s] < len(streams[s]) for s in streams):
        for s, packets in streams.items():
            if at[s] < len(packets):
                for data, granule in packets[at[s] : at[s] + most]:
                    out.append(writers[s].add(data, granule))
                at[s] += most
                out.append(writers[s].flush(LAST if at[s] >= len(packets) else 0))
    return b"".join(out)


def demux(data: bytes, strict: bool = True, lasting: Callable[[bytes, bytes], int] | None = None) -> Media:
    """Reads an Ogg file. `lasting` gives the time that a packet takes, from the first packet of its stream and itself. strict: a fault raises ValueError; else it is noted, and reading goes on at the next page."""
    media = Media()
    expected: dict[int, int] = {}
    partial: dict[int, bytearray | None] = {}
    before: dict[int, int] = {}
    heads: dict[int, bytes] = {}

    def fault(what: str) -> None:
        if strict:
            raise ValueError(what)
        media.errors.append(what)

    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + 27 > len(data):
            there = data.find(b"OggS", at + 1)
            fault(f"no page at byte {at}")
            at = there if there > 0 else len(data)
            continue
        _, version, flags, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBQIIIB", data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        whole = data[at:end]
        if version or end > len(data) or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            there = data.find(b"OggS", at + 1)
            fault(f"the page at byte {at} fails its checksum")
            at = there if there > 0 else len(data)
            continue
        if serial not in expected:
            media.serials.append(serial)
            if not flags & FIRST:
                fault(f"stream {serial} doesn't begin with its first page")
        elif sequence != expected[serial]:
            fault(f"stream {serial}: page {sequence} follows {expected[serial] - 1}")
            partial[serial] = None
        expected[serial] = sequence + 1
        held = partial.get(serial) if flags & CONTINUED else bytearray()
        ended, place = [], at + 27 + count
        for size in lacing:
            if held is not None:
                held += data[place : place + size]
            place += size
            if size < 255:
                if held is not None:
                    ended.append(bytes(held))
                held = bytearray()
        partial[serial] = held
        if ended:
            heads.setdefault(serial, ended[0])
        media.packets += [Packet(serial, x, time, media.pages) for x, time in zip(ended, _times(ended, granule, before.get(serial, 0), heads.get(serial, b""), lasting), strict=True)]
        if ended and granule != _NO_TIME:
            before[serial] = granule
        media.pages += 1
        at = end
    return media


def _times(packets: list[bytes], granule: int, before: int, head: bytes, lasting: Callable[[bytes, bytes], int] | None) -> list[int]:
    """The time at the end of each packet of a page: the last has the page's granule position."""
    if lasting is None:
        sizes = np.cumsum([len(p) for p in packets], dtype=np.int64).tolist()
        return [before + (granule - before) * x // sizes[-1] if sizes[-1] else granule for x in sizes]
    out, time = [], granule
    for p in reversed(packets):
        out.append(time)
        time -= lasting(head, p)
    return out[::-1]


def _lasting(head: bytes, packet: bytes) -> int:
    """What a packet moves its stream on by: its samples, and those of the other streams meanwhile; the first packet takes no time."""
    return 0 if packet == head else struct.unpack_from("<IHHQ", head, len(HEAD))[1] * STREAMS


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * ((max(1, -(-len(data) // UNIT)) * UNIT) - len(data))


def store(data: bytes) -> bytes:
    """The payload as an Ogg file of two streams."""
    base = zlib.crc32(data)
    streams: dict[int, list[tuple[bytes, int]]] = {}
    for s in range(STREAMS):
        head = HEAD + struct.pack("<IHHQ", RATE, UNIT, s, len(data))
        packets = [(data[i : i + UNIT], i + UNIT) for i in range(s * UNIT, len(data), STREAMS * UNIT)]
        streams[(base + s * 0x9E3779B9) & 0xFFFFFFFF] = [(head, 0), *packets]
    return mux(streams)


def load(stored: bytes) -> tuple[bytes, Media]:
    """The payload by reading the file back: the packets of all streams in the order of time."""
    media = demux(stored, lasting=_lasting)
    heads = {s: media.stream(s)[0].data for s in media.serials}
    timed = sorted((p for p in media.packets if p.data != heads[p.serial]), key=lambda p: p.granule)
    at = 0
    for p in timed:
        at += len(p.data)
        if p.granule != at:
            raise ValueError(f"a packet of stream {p.serial} ends at {p.granule}, where {at} samples were read")
    data = b"".join(p.data for p in timed)
    sizes = {struct.unpack_from("<IHHQ", h, len(HEAD))[3] for h in heads.values()}
    if sizes != {len(data)}:
        raise ValueError(f"{len(data)} samples of {sizes}")
    return data, media


def feature(data: bytes, media: Media) -> str:
    """Numbers of the signal and the container, as JSON."""
    x = np.frombuffer(data, np.uint8)
    centred = x.astype(np.int16) - 128
    return json.dumps({"streams": len(media.serials), "pages": media.pages, "packets": len(media.packets), "seconds": round(len(data) / RATE, 6), "mean": round(float(x.mean()), 6), "rms": round(float(np.sqrt(np.mean(centred.astype(np.float64) ** 2))), 6), "peak": int(np.abs(centred).max()), "crossings": int(np.count_nonzero(np.diff(np.signbit(centred)))), "times": [round(max((p.granule for p in media.stream(s)), default=0) / RATE, 6) for s in media.serials]}, separators=(",", ":"))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Per row: id, sizes and hashes of the payload as read back, the stored form's, its feature and, if asked for, the Ogg file itself."""
    kind = dict(docs.dtypes)[id_col]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + (", media binary" if with_media else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tv.chunks(batches, "text", 2 << 20):
            rows, files = [], []
            for text in batch.column("text").to_pylist():
                stored = store(payload(text))
                data, media = load(stored)
                rows.append((len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data, media)))
                files.append(stored)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            media_column = [pa.array(files, pa.binary())] if with_media else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, *media_column], [id_col, *names, *(["media"] if with_media else [])])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
