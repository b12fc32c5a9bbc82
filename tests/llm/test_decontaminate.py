import hashlib
import re

import pytest

from harrow.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in windows}:
                if (x := tuple(w[a : a + n])) in windows and len(x) == n:
                    hit |= set(range(a, a + n))
                    found |= windows[x]
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(d, b, **more)
    out = []
    for r in found.collect():
        hit = sum(s.stop - s.start for s in r.spans)
        out.append((r.doc_id, r.n_words, hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), hit > 0))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
DOCS = [(1, LONG), (2, "Xx " + LONG.upper() + " yy"), (3, None), (4, ""), (5, "a b, c. D"), (5, "a b, c. D"), (None, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (7, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (8, "é" * 5 + " a b c d e " * 2000), (9, "the the the the the the the the the the the")]
ITEMS = [(1, LONG), (2, "A b c d!"), (3, None), (4, ""), (None, "the " * 10), (10, LONG), (2, "a b c d"), (6, "solo")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_as_brute_force(spark, block):
    assert run(spark, DOCS, ITEMS, block_bytes=block) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, DOCS[:3], []) == brute(DOCS[:3], [])
    assert run(spark, [], ITEMS) == []


def test_real_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in decontaminate.query(spark, d).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


def test_many_blocks_and_any_columns(spark):
    """Each block is a job of its own; columns named as the results stay those of the input."""
    items = [(i, " ".join(f"v{i}x{j}" for j in range(12))) for i in range(12)]
    docs = [(k, f"start {items[k % 12][1]} middle {items[(k + 1) % 12][1]} end") for k in range(30)] + [(99, "clean text"), (None, None)]
    assert run(spark, docs, items, block_bytes=100) == brute(docs, items)
    rows = spark.createDataFrame([(k, t, 7, ["x"], k) for k, t in docs], "doc_id long, text string, n_words int, spans array<string>, kept long")
    for size in (100, 1 << 20):
        left = decontaminate.decontaminated(rows, spark.createDataFrame(items, "item_id long, text string"), block_bytes=size)
        assert left.columns == rows.columns and sorted(map(str, left.collect())) == sorted(map(str, rows.where("coalesce(text, '') in ('clean text', '')").collect()))


def test_a_task_holds_the_words_of_about_a_megabyte():
    import pyarrow as pa

    texts = ["x" * 1000] * 5000
    runs = list(decontaminate._slices(pa.array(texts)))
    assert sum(len(r) for _, r in runs) == len(texts) and max(sum(map(len, r)) for _, r in runs) <= (1 << 20) + 1000
