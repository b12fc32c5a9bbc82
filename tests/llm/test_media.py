import hashlib
import struct
import zlib

import pytest

from harrow.llm import media

TEXTS = [None, "", "a", "x" * 64, "é" * 100, "long " * 50_000, "a"]


def test_round_trip_and_columns(spark):
    df = spark.createDataFrame([(i if i else None, t, "m") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    rows = media.media_columns(df).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        raw = (TEXTS[r.doc_id or 0] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert b"".join(bytes(r.media)[k.start : k.stop] for k in r.keyframes[:1]) == payload[:64]
        assert len(r.keyframes) == -(-len(payload) // 1024) and r.codec == "raw" and r.duration == len(payload) / 8000
    assert media.media_columns(df.limit(0)).count() == 0


def test_reader_takes_other_layouts():
    """32-bit offsets, sizes of their own, no sync table: every sample is a keyframe."""
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = lambda at: media._box(
        b"stbl", media._full(b"stsd", u(1), media._box(b"twos", bytes(28))), media._full(b"stsc", u(2, 1, 2, 1, 2, 1, 1)), media._full(b"stsz", u(0, 3, 5, 6, 7)), media._full(b"stco", u(2, at, at + 20))
    )
    build = lambda at: media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", u(0, 0, 100, 250, 0)), media._box(b"minf", stbl(at)))))
    at = len(build(0)) + 8
    data = build(at) + media._box(b"mdat", b"aaaaabbbbbb.........ccccccc")
    (t,) = media.read_media(data)
    assert t["codec"] == "twos" and t["duration"] == 2.5 and t["keyframes"] == [(at, at + 5), (at + 5, at + 11), (at + 20, at + 27)]
    assert media.read_payload(data, t) == b"aaaaabbbbbbccccccc"


def test_broken_boxes():
    for bad in (b"\0\0\0", struct.pack(">I4s", 100, b"moov"), struct.pack(">I4s", 4, b"free")):
        with pytest.raises(ValueError):
            list(media.walk(bad))


def test_sample_times_and_edit_list():
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = lambda at: media._box(b"stbl", media._full(b"stsd", u(1), media._box(b"raw ", bytes(28))), media._full(b"stts", u(2, 2, 10, 1, 30)), media._full(b"stss", u(2, 1, 3)), media._full(b"stsc", u(1, 1, 3, 1)), media._full(b"stsz", u(4, 3)), media._full(b"stco", u(1, at)))
    edits = media._box(b"edts", media._full(b"elst", u(1, 50, 5, 0x10000)))
    build = lambda at: media._box(b"moov", media._box(b"trak", edits, media._box(b"mdia", media._full(b"mdhd", u(0, 0, 10, 0, 0)), media._box(b"minf", stbl(at)))))
    at = len(build(0)) + 8
    (t,) = media.read_media(build(at) + media._box(b"mdat", bytes(12)))
    assert t["duration"] == 5.0 and t["key_times"] == [-0.5, 1.5] and t["keyframes"] == [(at, at + 4), (at + 8, at + 12)]


def test_binary_columns_are_described(spark):
    good = media.write_media(bytes(64 * 40))
    cut = good[: good.index(b"stsz") + 8] + good[good.index(b"stsz") + 12 :]
    beyond = good.replace(struct.pack(">3I", 3, 1, 17), struct.pack(">3I", 3, 1, 99))
    assert beyond != good
    df = spark.createDataFrame([("a", good, 1), ("b", None, 1), ("c", b"no container", 1), ("d", cut, 1), ("e", beyond, 1), ("f", b"", 1), ("a", good, 1)], "name string, media binary, found int")
    got = media.describe(df).collect()
    assert [(r.name, len(r.found.tracks), r.found.error is None) for r in got] == [("a", 1, True), ("b", 0, True), ("c", 0, False), ("d", 0, False), ("e", 0, False), ("f", 0, True), ("a", 1, True)]
    t = got[0].found.tracks[0]
    assert (t.codec, t.duration, t.n_samples) == ("raw", 2560 / 8000, 40) and [k["at"] for k in t.keyframes] == [0.0, 16 * 64 / 8000, 32 * 64 / 8000]
    assert all(good[k["start"] : k["stop"]] == bytes(64) for k in t.keyframes)


def test_keys_of_any_type_and_feature(spark):
    df = spark.createDataFrame([("x1", "a" * 2000), (None, None), ("x1", "")], "doc_id string, text string")
    assert [(r.doc_id, r.n_bytes) for r in media.media_columns(df).collect()] == [("x1", 2000), (None, 0), ("x1", 0)]
    d = "/root/testdata/sf0.001"
    sizes = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in media.query(spark, d).collect():
        n = max(64, -(-sizes[r.doc_id] // 64) * 64)
        start = r.media_bytes - n
        ranges = ",".join(f"{start + 64 * k}-{start + 64 * k + 64}" for k in range(0, n // 64, 16))
        assert r.feature == f"codec=raw;seconds={n / 8000:.3f};keyframes={-(-n // 1024)};ranges={zlib.crc32(ranges.encode())}"
