import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harrow.llm import packing

ODD = ["", None, " ", "a  b", " lead", "trail ", "new\n line\n\n x", "tab\tx y", "a b c", "it's  I'll we've", "é à ü 日本 語", "word " * 3000 + "end", "<|endoftext|> is text", "a <|endoftext|> b", "\nlead\nlines", "crlf\r\nline", "end\n", "a.\nB 12,5%! (x) 'll don't", "\x85x\xa0y\xad¡", "a b", "a b"]


@cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def whole(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs):
    bodies = {k: whole(t) for k, t in docs}
    seen = {k: [] for k in bodies}
    windows = {}
    for r in rows:
        ids = np.array(bodies[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(bodies[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in seen.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == len(bodies[k])
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return windows


@pytest.mark.parametrize("partitions", [1, 5])
def test_each_id_lies_in_one_piece(spark, partitions):
    docs = list(enumerate(ODD))
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, length int").repartition(partitions)
    check(packing.pack(df, keep_ids=False, open_windows=2, fan_in=2).collect(), docs)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = packing.query(spark, d).collect()
    windows = check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    used = sum(r.length for r in rows)
    assert used / (1024 * len(windows)) > 0.98


def test_encoder_forgets_and_stays_right():
    encode = packing.Encoder(limit=3)
    for t in ["one two three four five six", "one two seven eight", "nine ten one two"]:
        assert encode([t])[0] == np.array(whole(t)[:-1], "<u4").tobytes()


def test_encoder_as_the_plain_call():
    import random

    draw, signs = random.Random(5), ["a", "bé", "ß", "Z9", "'s", "'", ".", ",", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "½", "ǆ", "語", "\x1c", "<|endoftext|>"]
    texts = ["".join(draw.choices(signs, [8, 8, 4, 4, 3, 2, 4, 4, 20, 1, 4, 1, 1, 1, 0.2, 1, 1, 0.1, 0.1, 0.1], k=draw.randrange(60))) for _ in range(3000)]
    encode = packing.Encoder()
    for t in texts:
        assert encode.one(t) == np.array(whole(t)[:-1], "<u4").tobytes(), repr(t)


def test_keys_of_any_type(spark):
    df = spark.createDataFrame([("a", "one two"), (None, "three"), ("a", None)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.doc_tokens) for r in packing.pack(df, keep_ids=False).collect()) == [("None", 2), ("a", 1), ("a", 3)]


def test_placement_is_best_fit():
    """Against brute force: an item goes to the open window where least room is left; none fits and all are open: the fullest closes."""
    import random

    draw = random.Random(3)
    windows, open_, closed, want = packing.OpenWindows(100, 5), [], [], []
    for k in range(500):
        size = draw.randrange(1, 100)
        if got := windows.add(size, [(k, size)]):
            closed.append([x for x in got if x is not None])
        fits = [w for w in open_ if w[0] >= size]
        full = None
        if fits:
            w = min(fits, key=lambda w: w[0])
        else:
            if len(open_) >= 5:
                full = min(open_, key=lambda w: w[0])
                open_.remove(full)
            w = [100, []]
            open_.append(w)
        w[0] -= size
        w[1].append((k, size))
        done = [*(full[1] if full else []), *(w[1] if not w[0] else [])]
        if not w[0]:
            open_.remove(w)
        if done:
            want.append(done)
    assert [sum(s for _, s in c) for c in closed] == [sum(s for _, s in c) for c in want]
