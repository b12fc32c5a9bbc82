import hashlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from harrow.llm import alignment

ODD = [
    None, "", " ", "  ", "a", "a  b", " lead", "trail ", "new\n line\n\n x", "tab\tx y", "it's  I'll we've can't", "é à ü 日本 語", "é ﬁ Ａ", "▁ block", "<|endoftext|> and </s> <s> <unk> are text", "<0x41>",
    "\nlead\nlines", "one\ntwo\nthree four", "crlf\r\nline", "end\n", "\x85x\xa0y\xad¡", "x\x00y", "unbelievably internationalisation 3.14159 -- ((x))", "word " * 3000 + "end", "z" * 5000, "one\ntwo\nthree four", "\U0001f600 smile",
]


@cache
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), letters


def brute(texts):
    """Every pair of tokens of a document compared by its byte range."""
    a, b, letters = tools()
    rows, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(None)
            continue
        ranges = []
        for parts in (bytes_a, bytes_b):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            ranges.append(own)
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, links, start = [], [], 0
        by_start = [defaultdict(list) for _ in range(2)]
        for side in range(2):
            k = 0
            for n, (s, _) in enumerate(ranges[side]):
                while s >= cuts[k]:
                    k += 1
                by_start[side][k].append(n)
        for k in range(len(cuts)):
            groups.append(",".join(str(ids_a[n]) for n in by_start[0][k]) + "|" + ",".join(str(ids_b[n]) for n in by_start[1][k]))
            links += [(ids_a[i], ids_b[j]) for i in by_start[0][k] for j in by_start[1][k] if ranges[0][i][0] < ranges[1][j][1] and ranges[1][j][0] < ranges[0][i][1]]
        held.update(set(links))
        rows.append((len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(r[0], r[1], r[2], len(r[3]), sum(held[x] == best[x[0]] for x in r[3]), sum(held[x] for x in r[3]), r[4]) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


def result(spark, texts, most=alignment.HOT_PAIRS, key="long"):
    docs = spark.createDataFrame([(str(k) if key == "string" else k, t, 7, "x") for k, t in enumerate(texts)], f"doc_id {key}, text string, n_a int, pairs string").repartition(3)
    linked = alignment.align(docs)
    rows = alignment.scored(linked, alignment.pair_counts(linked), most).collect()
    return {int(r.key): (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows}, len(rows)


@pytest.mark.parametrize(("most", "key"), [(alignment.HOT_PAIRS, "long"), (5, "string"), (0, "long")])
def test_odd_texts_as_brute_force(spark, most, key):
    found, n = result(spark, ODD, most, key)
    assert n == len(ODD) and [found[k] for k in range(n)] == brute(ODD)


def test_documents_as_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = dict(zip((r["doc_id"] for r in docs), brute([r["text"] for r in docs]), strict=True))
    rows = alignment.query(spark, d).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows} == want


def test_null_and_repeated_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "")], "doc_id long, text string")
    linked = alignment.align(docs)
    rows = sorted(alignment.scored(linked, alignment.pair_counts(linked)).collect(), key=lambda r: r.n_a)
    assert [(r.key, r.n_a, r.n_links, r.n_best, r.count_sum) for r in rows] == [(1, 0, 0, 0, 0)] * 2 + [(None, 2, 2, 2, 4)] * 2
    empty = alignment.align(docs.limit(0))
    assert alignment.scored(empty, alignment.pair_counts(empty)).count() == 0


def test_transducer():
    machine = alignment.Transducer([b"ab", b"c", b"abc", b""], [b"a", b"bc", b"abc", b"x"])
    assert machine.run([0, 1], [0, 1]) == ("0,1|0,1", [0 << 16 | 0, 0 << 16 | 1, 1 << 16 | 1])
    assert machine.run([2, 0, 1], [2, 2]) == ("2|2;0,1|2", [2 << 16 | 2, 0 << 16 | 2, 1 << 16 | 2])
    assert machine.run([0], [0]) is None and machine.run([0], [3]) is None and machine.run([1], []) is None and machine.run([], [1]) is None
    assert machine.run([], []) == ("", [])
    known = machine.known
    machine.run([0, 1], [0, 1])
    assert machine.known == known  # every transition was memoised
    machine.limit = 0
    assert machine.run([0, 1], [0, 1])[0] == "0,1|0,1"
