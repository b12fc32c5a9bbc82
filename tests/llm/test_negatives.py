import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from harrow.llm import negatives
from harrow.llm.vectors import augmented, distances, farthest


def brute(rows, every, positives, negatives_, low, high):
    """rows: (key, label, vector of whole numbers)."""
    length = [len(v) for k, lab, v in rows if k is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dim = max(set(length), key=lambda n: (length.count(n), n)) if length else 0
    rows = [(k, lab, v) for k, lab, v in rows if k is not None and lab is not None and v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (k, lab, v) in enumerate(rows):
        if k % every:
            continue
        scores = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), o, other) for m, (o, other, w) in enumerate(rows) if m != n]
        for ps, p, _ in sorted(s for s in scores if s[2] == lab)[:positives]:
            fit = sorted(s for s in scores if s[2] != lab and low * -ps <= 100 * -s[0] <= high * -ps)
            out += [(k, p, r + 1, o, -ps, -s) for r, (s, o, _) in enumerate(fit[:negatives_])]
    return sorted(out)


def result(spark, rows, every, positives=5, count=10, low=30, high=90, partitions=3, **sizes):
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, label int, embedding array<double>, row double, cell string").repartition(partitions)
    found = negatives.hard_negatives(df, every=every, positives=positives, negatives=count, low=low, high=high, **sizes)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("sizes", [{}, {"cell": 7, "block": 3, "pivots": 4}])
def test_as_brute_force(spark, sizes):
    draw = np.random.default_rng(3)
    middle = draw.integers(-40, 40, (5, 6))
    rows = [(i, int(draw.integers(4)), [float(x) for x in middle[i % 5] + draw.integers(-6, 6, 6)]) for i in range(160)]
    rows += [(1000 + i, i % 3, [10.0] * 6) for i in range(60)]  # copies: ties
    odd = [(7, None, [1.0] * 6), (None, 1, [1.0] * 6), (9, 1, None), (10, 1, []), (20, 1, [1.0] * 5), (30, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (40, 2, [math.nan] + [1.0] * 5), (50, 2, [math.inf] + [1.0] * 5), (60, 3, [0.0] * 6)]
    assert result(spark, rows + odd, 10, **sizes) == brute(rows + odd, 10, 5, 10, 30, 90)


def test_repeated_rows_few_rows_and_empty_table(spark):
    rows = [(0, 1, [3.0, 4.0]), (0, 1, [3.0, 4.0]), (1, 2, [2.0, 2.0]), (1, 2, [2.0, 2.0]), (2, 3, [-1.0, -1.0])]
    found = result(spark, rows, 10)
    assert found == [(0, 0, 1, 1, 25, 14)] * 2 + [(0, 0, 2, 1, 25, 14)] * 2 == brute(rows, 10, 5, 10, 30, 90)
    assert result(spark, [(0, 1, [1.0, 1.0])], 10) == []
    assert result(spark, [(1, 1, [1.0]), (3, 2, [1.0])], 10) == []  # no anchor
    assert result(spark, [], 10) == []


def test_negative_and_zero_positive_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-2.0, 0.0]), (2, 1, [0.0, 5.0]), (3, 2, [0.0, 1.0]), (4, 2, [-1.0, 0.0])]
    assert result(spark, rows, 10) == [(0, 2, 1, 3, 0, 0)] == brute(rows, 10, 5, 10, 30, 90)


def test_brackets_hold():
    draw = np.random.default_rng(5)
    q, x = draw.integers(-50, 50, (20, 8)).astype(float), draw.integers(-50, 50, (300, 8)).astype(float)
    most = float(max((q * q).sum(1).max(), (x * x).sum(1).max()))
    points = augmented(x, most)
    at = points[farthest(points, 6)]
    da = distances(np.hstack([q, np.zeros((20, 1))]), at).astype(np.float32).astype(float)
    dx = distances(points, at).astype(np.float32).astype(float)
    low, high = negatives.brackets(da, dx, (q * q).sum(1), most)
    scores = q @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    assert (high < scores.max()).any()  # some are told apart without their vectors


def test_documents_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    t = pq.read_table(f"{d}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in t]
    found = sorted(map(tuple, negatives.query(spark, d).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert found == brute(rows, 100, 5, 10, 30, 90)
