import random
from itertools import combinations

import pytest

from harrow.llm import neardup


def grams(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width, percent):
    sets = [grams(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i)), k == least.get(find(i))) for i, (k, _) in enumerate(docs)), key=str)


def run(spark, docs, width=3, percent=85, **more):
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in docs], "doc_id long, text string, row int, sig string")
    got = neardup.NearDuplicates(df, width, percent, **more).classes().collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_as_brute_force_near_the_limit(spark):
    texts = [t for s in range(12) for t in family(s, 12, 120 + 20 * s, 2 + s % 7)]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    assert run(spark, docs) == brute(docs, 3, 85)


def test_edge_cases(spark):
    docs = [(5, "A b C"), (3, "a B c"), (3, "a B c"), (None, "a b c"), (None, None), (9, None), (9, ""), (8, " \t\n"), (7, "one"), (6, "ONE"), (4, "one two"), (None, "alone here now"), (2, "ä Ä b"), (1, "ä ä b"), (10, "long " * 30_000), (11, "long " * 29_000)]
    assert run(spark, docs) == brute(docs, 3, 85)
    assert run(spark, []) == []


@pytest.mark.parametrize("width, percent, more", [(3, 85, {}), (5, 80, {"chunks": 8, "radius": 26})])
def test_real_documents_and_other_indexes(spark, width, percent, more):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, docs, width, percent, **more)
    assert got == brute(docs, width, percent)
    assert any(r[0] != r[2] for r in got)


def test_one_row_of_each_component_stays(spark):
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "A b c d e f"), (3, "other words stand here now"), (3, "other words stand here now"), (None, "a b c d e f"), (4, None), (5, ""), (None, "lone text without an id"), (None, "lone text without an id")]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(texts)], "doc_id long, text string, node int")
    got = neardup.NearDuplicates(df).deduplicated()
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b c d e f"), (3, "other words stand here now"), (4, None), (5, ""), (None, "lone text without an id")], key=str)


def test_radius():
    assert neardup.radius_for(85, 64) == 23 and neardup.radius_for(80, 64) == 28


def test_every_pair_within_the_radius_shares_a_key():
    rng = random.Random(3)
    kept = neardup.masks(64, 12, 23)
    for _ in range(200):
        differ = set(rng.sample(range(64), 23))
        assert any(not differ & set(k) for k in kept)


def test_each_pair_comes_from_the_first_chunk_it_shares(spark):
    import numpy as np

    found = neardup.NearDuplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(200):
        a = rng.integers(0, 1 << 16, 64, np.uint64).astype("<u2")
        b = a.copy()
        at = rng.permutation(64)[: rng.integers(0, 40)]
        b[at] ^= rng.integers(1, 1 << 16, len(at)).astype("<u2")
        shared = [k for k, (_, keys) in enumerate(found.chunks) if any(np.array_equal(a[m], b[m]) for m in keys)]
        rows.append((a.view(np.int64).tolist(), b.view(np.int64).tolist(), min(shared, default=None)))
        assert shared or (a != b).sum() > found.radius
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want int")
    assert [r for r in df.select("want", found._first_chunk("a", "b").alias("got")).collect() if r.want != r.got] == []
    assert len({r[2] for r in rows}) > 3


def framed(n, own, frame=100, seed=4):
    rng = random.Random(seed)
    base = [f"f{i}" for i in range(frame)]
    return [" ".join([*base, *(f"o{rng.randrange(10**9)}" for _ in range(own))]) for _ in range(n)]


def cpu_seconds(spark, work):
    """What Spark's tasks take of the CPU beside their Python."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(e.totalDuration() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(False))) / 1000
    before = total()
    work()
    return total() - before


def test_texts_around_a_common_frame_cost_as_unlike_ones(spark):
    run(spark, [(i, t) for i, t in enumerate(framed(50, 30))])  # what only a first run takes
    unlike = cpu_seconds(spark, lambda: run(spark, [(i, t) for i, t in enumerate(framed(1200, 130, 0))]))
    alike = cpu_seconds(spark, lambda: run(spark, [(i, t) for i, t in enumerate(framed(1200, 30))]))
    assert alike < 3 * unlike + 5


def test_similar_sets_of_a_crowd_meet(spark):
    texts = [*framed(200, 30), *framed(60, 9, seed=5), *(t for s in range(6) for t in family(s, 25, 90 + 30 * s, 6)), *family(9, 40, 12, 2), "one two", "one two three", "one"]
    docs = [(i, t) for i, t in enumerate(dict.fromkeys(texts))]
    found = neardup.NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85)
    reps = found.signatures().selectExpr("doc_id as node", "n_shingles as n", "row", "same", "sig", "parity").localCheckpoint()
    met = {(r.a, r.b) for r in found.meetings(reps.selectExpr("node", "node as root", "n"), reps).collect()}
    sets = [grams(t, 3) for _, t in docs]
    near = {(i, j) for i, j in combinations(range(len(docs)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert near and near <= met
    assert not [(a, b) for a, b in met if b < 200]  # of texts around a frame none meet
    apart = found.meetings(reps.selectExpr("node", "node % 7 as root", "n"), reps).collect()
    assert {p for p in near if p[0] % 7 != p[1] % 7} <= {(r.a, r.b) for r in apart}
    assert all(r.a % 7 != r.b % 7 for r in apart)


def test_crowded_buckets_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 1)
    texts = [*framed(80, 12), *framed(40, 30), *(t for s in range(6) for t in family(s, 30, 90 + 30 * s, 9 + s)), *family(9, 40, 12, 2)]
    docs = [(5000 - i, t) for i, t in enumerate(texts)] + [(4990, texts[10]), (4990, texts[10]), (7, texts[11].upper())]
    assert run(spark, docs) == brute(docs, 3, 85)
