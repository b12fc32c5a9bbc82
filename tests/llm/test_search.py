import math

import numpy as np
import pytest

from harrow.llm import search


def brute(rows, every, k):
    out = {}
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            out.setdefault(q, []).extend(sorted((-sum(a * b for a, b in zip(v, w, strict=True)), o) for m, (o, w) in enumerate(rows) if m != n)[:k])
    return out


def result(spark, rows, partitions=3, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, row int, score string").repartition(partitions)
    found = {}
    for r in sorted(search.nearest(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return found


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_recall_against_brute_force(spark, spread):
    draw = np.random.default_rng(11)
    middle = draw.standard_normal((12, 24))
    rows = [(i, (middle[i % 12] + spread * draw.standard_normal(24)).tolist()) for i in range(2400)]
    found, want = result(spark, rows, list_rows=100, cell=60, block=40), brute(rows, 20, 20)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    known = {q: dict((o, s) for s, o in brute([r for r in rows if r[0] == q or r[0] in {o for _, o in found[q]}], 20, 20)[q]) for q in [0, 20, 400]}
    assert all(abs(known[q][o] - s) < 1e-12 for q in known for s, o in found[q])
    hit = sum(len({o for _, o in found[q]} & {o for _, o in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(v == sorted(v) for v in found.values())


def test_odd_rows(spark):
    good = [(20 * i, [math.sin(i), math.cos(3 * i), float(i)]) for i in range(1, 40)] + [(3, [1.0, 1.0, 1.0])] * 30  # copies, ties
    odd = [(40, None), (None, [1.0, 1.0, 1.0]), (60, []), (80, [0.0, 0.0, 0.0]), (100, [1.0]), (120, [1.0, None, 1.0]), (140, [math.nan, 1.0, 1.0]), (160, [-math.inf, 1.0, 1.0]), (180, [1e300, 1.0, 1.0])]
    found, want = result(spark, good + odd, list_rows=1000), brute(good, 20, 20)
    assert found.keys() == want.keys()
    for q in want:
        assert [o for _, o in found[q]] == [o for _, o in want[q]] and np.allclose([s for s, _ in found[q]], [s for s, _ in want[q]])


def test_fewer_rows_than_asked_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5])]
    found = result(spark, rows)
    assert [o for _, o in found[0]] == [1, 20, 20] and len(found[20]) == 6
    assert result(spark, []) == {} and result(spark, [(0, [1.0])]) == {}
    # Lists with fewer rows than asked for: more are probed.
    many = [(i, [math.cos(i / 7), math.sin(i / 7)]) for i in range(60)]
    found = result(spark, many, list_rows=2, recall=0.01)
    assert all(len(v) == 20 for v in found.values()) and found.keys() == {0, 20, 40}


def test_scan_keeps_what_is_near():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((4000, 65)).astype(np.float32)
    q = x[:50] + 0.3 * draw.standard_normal((50, 65)).astype(np.float32)
    apart = ((q[:, None].astype(float) - x) ** 2).sum(2)
    within = np.sort(apart, 1)[:, 20]
    i, j = search.scan(q, x, within, search.shares(65))
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    near = list(zip(*map(np.ndarray.tolist, np.nonzero(apart <= within[:, None])), strict=True))
    assert sum(p in kept for p in near) >= 0.98 * len(near)
    assert all(apart[a, b] <= within[a] * 1.001 for a, b in kept)
    assert np.allclose(search.rotation(9) @ search.rotation(9).T, np.eye(9))


def test_shares():
    tests = search.shares(65)
    assert [d for d, _ in tests] == [16, 32, 48, 64, 65] and tests[-1][1] == 1
    assert all(d / 65 < s <= 1 for d, s in tests[:-1])


def test_tables(spark):
    rows = search.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 and {r.rank for r in rows} == set(range(1, 21))
