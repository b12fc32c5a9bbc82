"""Media columns: an ISO base media container for each text, and a reader of its boxes.

A payload is stored as 8-bit samples in access units of 64 bytes. The reader
walks the nested boxes and decodes the sample tables; it gives codec, duration
and the byte ranges of keyframes without decoding a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNIT, RATE, KEY_EVERY, CHUNK_UNITS = 64, 8000, 16, 1024
# Fixed values of the ISO base media file format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", 8 + len(data), kind) + data if len(data) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(data)) + data


def _full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


def write_media(payload: bytes) -> bytes:
    """One track of 8-bit mono PCM whose access units are UNIT bytes; every KEY_EVERY-th is a sync sample."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes")
    length = units * UNIT
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    chunks = -(-units // CHUNK_UNITS)
    last = units - (chunks - 1) * CHUNK_UNITS
    runs = [(1, CHUNK_UNITS)] if chunks > 1 else []
    if chunks == 1 or last != CHUNK_UNITS:
        runs.append((chunks, last))
    keys = range(1, units + 1, KEY_EVERY)

    def moov(start: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, units, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, units)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(start + i * CHUNK_UNITS * UNIT for i in range(chunks)))),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xhhhH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) >= 2**32 - 8 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the body, end) of each box, outer before inner. A box that leaves its parent is an error."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut short")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def read_media(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration (seconds), samples as (offset, size), keyframes as [start, end) bytes and
    their times in seconds, by the sample durations less what an edit list skips. Broken media are a ValueError."""
    try:
        return _tracks(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a table is cut short or points outside: {e}") from e


def _tracks(data: bytes) -> list[dict]:
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": None, "timescale": 0, "ticks": 0, "sizes": [], "runs": [], "chunks": [], "sync": None, "deltas": [], "skipped": 0})
        if len(path) < 2 or b"trak" not in path or kind == b"trak":
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["ticks"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        elif kind == b"stsd":
            t["codec"] = data[at + 12 : at + 16].decode("latin-1").strip()
        elif kind == b"stts":
            n = struct.unpack_from(">I", data, at + 4)[0]
            t["deltas"] = [struct.unpack_from(">II", data, at + 8 + 8 * i) for i in range(n)]
        elif kind == b"elst" and struct.unpack_from(">I", data, at + 4)[0]:
            t["skipped"] = max(0, struct.unpack_from(">q", data, at + 16)[0] if data[at] == 1 else struct.unpack_from(">i", data, at + 12)[0])
        elif kind == b"stss":
            n = struct.unpack_from(">I", data, at + 4)[0]
            t["sync"] = struct.unpack_from(f">{n}I", data, at + 8)
        elif kind == b"stsc":
            n = struct.unpack_from(">I", data, at + 4)[0]
            t["runs"] = [struct.unpack_from(">III", data, at + 8 + 12 * i) for i in range(n)]
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", data, at + 4)
            t["sizes"] = [each] * n if each else list(struct.unpack_from(f">{n}I", data, at + 12))
        elif kind in (b"stco", b"co64"):
            n = struct.unpack_from(">I", data, at + 4)[0]
            t["chunks"] = struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, at + 8)
    for t in tracks:
        samples, k, run = [], 0, 0
        for i, offset in enumerate(t.pop("chunks"), 1):
            while run + 1 < len(t["runs"]) and t["runs"][run + 1][0] <= i:
                run += 1
            for size in t["sizes"][k : k + t["runs"][run][1]]:
                samples.append((offset, size))
                offset += size
            k += t["runs"][run][1]
        if len(samples) != len(t["sizes"]):
            raise ValueError("chunks and sample sizes disagree")
        if t["deltas"] and sum(n for n, _ in t["deltas"]) != len(samples):
            raise ValueError("sample durations and sizes disagree")
        if any(offset + size > len(data) for offset, size in samples):
            raise ValueError("a sample leaves the file")
        sync = range(1, len(samples) + 1) if t["sync"] is None else t["sync"]
        if any(not 1 <= j <= len(samples) for j in sync):
            raise ValueError("a keyframe is no sample")
        scale, ticks = t["timescale"] or 1, t.pop("ticks") or sum(n * d for n, d in t["deltas"])
        t["duration"] = ticks / scale if t["timescale"] else 0.0
        t["samples"] = samples
        t["keyframes"] = [(samples[j - 1][0], sum(samples[j - 1])) for j in sync]
        starts = list(accumulate((d for n, d in t["deltas"] for _ in range(n)), initial=0))
        t["key_times"] = [(starts[j - 1] - t["skipped"]) / scale if t["deltas"] else None for j in sync]
        for k in ("sizes", "runs", "sync", "deltas", "skipped"):
            t.pop(k)
    return tracks


def read_payload(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, by its sample table; runs of touching samples are read at once."""
    parts, start, stop = [], 0, 0
    for offset, size in track["samples"]:
        if offset != stop:
            parts.append(data[start:stop])
            start = offset
        stop = offset + size
    return b"".join([*parts, data[start:stop]])


_MEDIA = pa.schema([("n_bytes", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("codec", pa.string()), ("duration", pa.float64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
MEDIA_COLUMNS = "n_bytes long, media binary, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, codec string, duration double, keyframes array<struct<start:long, stop:long>>"


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """Store each whole text as ISO media and describe it from its boxes, one row in, one row out.

    No row meets another, so nothing is shuffled, and a task holds one batch.
    Null and empty texts are 64 zero bytes; null or repeated keys, of any type, pass through; an empty table gives no row.
    """
    kind = docs.schema[key].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            weight = start = 0
            for i, t in enumerate(batch.column(1), 1):
                raw = (t.as_py() or "").encode()
                media = write_media(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)))
                (track,) = read_media(media)
                payload = read_payload(media, track)
                held.append((len(raw), media if keep_media else None, len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), track["codec"], track["duration"], [{"start": a, "stop": b} for a, b in track["keyframes"]]))
                weight += len(media)
                if weight > 16 << 20 or i == len(batch):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _MEDIA, strict=True)]
                    yield pa.record_batch([batch.column(0).slice(start, i - start), *columns], names=["row_key", *_MEDIA.names])
                    held, weight, start = [], 0, i

    return docs.select(docs[key].alias("row_key"), docs[text].alias("body")).mapInArrow(store, f"row_key {kind}, {MEDIA_COLUMNS}").withColumnRenamed("row_key", key)


_TRACKS = "tracks array<struct<codec:string, duration:double, n_samples:long, keyframes:array<struct<start:long, stop:long, at:double>>>>, error string"


def describe(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with a struct ``found``, in place of an input column of that name, for the containers in a binary column: tracks (codec, duration in seconds, number of
    samples, byte ranges and seconds of keyframes) and error.

    Payloads are not decoded. Null has no tracks and no error; bytes that are no
    container, or a broken one, have an error that says what is wrong; repeated rows get the same.
    """

    def look(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            out = []
            for data in column:
                try:
                    found = read_media(data) if data is not None else []
                    out.append(([{"codec": t["codec"], "duration": t["duration"], "n_samples": len(t["samples"]), "keyframes": [{"start": a, "stop": b, "at": s} for (a, b), s in zip(t["keyframes"], t["key_times"], strict=True)]} for t in found], None))
                except ValueError as e:
                    out.append(([], str(e)))
            yield pd.DataFrame(out, columns=["tracks", "error"])

    return rows.withColumn("found", F.pandas_udf(look, _TRACKS)(F.col(media)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.concat_ws(",", F.transform("keyframes", lambda r: F.concat_ws("-", r["start"], r["stop"])))
    feature = F.concat(F.lit("codec="), "codec", F.lit(";seconds="), F.format_string("%.3f", "duration"), F.lit(";keyframes="), F.size("keyframes").cast("string"), F.lit(";ranges="), F.crc32(ranges.cast("binary")).cast("string"))
    return media_columns(table(spark, sf_dir, "documents"), keep_media=False).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
