import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.operators import folds, items, scans
from harrow.streaming import queue

OPS = ["push", "fetch", "ack", "fail", "release", "claim", "commit", "recover"]


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def log(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(OPS), f"w{rng.randrange(2)}", float(i * 50 + rng.randrange(200))) for i in range(400)]
    rows += [(1000, 2**53 + 1, "push", "w0", None), (1001, 2**53, "fail", "w1", 1.0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "seq long, item long, op string, by string, t double")


def by_item(rows):
    return {k: sorted(r for r in rows if r[1] == k) for k in {r[1] for r in rows}}


def whole(df):
    """No operator gathers a key's log in one value."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan, plan
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_queue(spark, small_batches):
    rows, df = log(spark)
    want = {}
    for k, own in by_item(rows).items():
        s = ["absent", 0, 0, 0, 0, 0]
        for r in own:
            queue._apply(s, r[2], 1)
        want[k] = tuple(s)
    assert whole(queue.replay(df, "item", "op", ["seq"], 1)) == want


def test_rate_level_and_strikes(spark, small_batches):
    rows, df = log(spark)
    levels, strikes = {}, {}
    for k, own in by_item(rows).items():
        level = streak = n = 0
        for r in own:
            streak += 1
            if r[2] == "fail":
                level, streak = min(level + 1, 3), 0
            elif streak == 5:
                level, streak = max(level - 1, 0), 0
        levels[k] = (level, streak, round(1.5**level, 6))
        at = None
        for t in sorted(r[4] for r in own if r[4] is not None):
            n, at = (max(n - 1, 0) if at is not None and t - at > 120 else n) + 1, t
        strikes[k] = (n, min(60.0, 3.0 * 2.0 ** (n - 1)))
    assert whole(folds.rate_level(df, "item", ["seq"], F.col("op") == "fail")) == levels
    assert whole(folds.strikes(df, "item", F.col("t"))) == strikes


def test_items(spark, small_batches):
    kind = "seq long, item string, op string, by string"
    rows = [(1, "a", "claim", "x"), (2, "a", "claim", "y"), (3, "a", "ack", "x"), (4, "a", "release", "x"), (5, "a", "claim", "y"), (6, "a", "commit", "y"), (7, "a", "fail", "x"), (8, "a", "ack", "x"), (9, "a", "claim", "x")]
    rows += [(i, "b", "ack", "x") for i in range(30)] + [(50, "b", "claim", "z")]
    got = whole(items.replay(spark.createDataFrame(rows[::-1], kind), "item", "op", "by", ["seq"]))
    assert got == {"a": ("acked", "durable", "y", 2, True, 2), "b": ("claimed", "staged", "z", 1, False, 30)}
    assert whole(items.replay(spark.createDataFrame([], kind), "item", "op", "by", ["seq"])) == {}


@pytest.mark.parametrize("most", [0, 1, 3])
def test_hot_key_over_many_tasks(spark, most):
    """One key has nine tenths of the rows; they are dealt over eight tasks, and no window or group holds them all."""
    rng = random.Random(most)
    rows = [(i, 1 if rng.random() < 0.9 else rng.randrange(2, 9), rng.random() < rng.choice([0.05, 0.3, 0.6]), rng.expovariate(0.02)) for i in range(6000)]
    at, timed = 0.0, []
    for i, k, bad, gap in rows:
        at += gap
        timed.append((i, k, bad, at))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(random.Random(1).sample(timed, len(timed)), "seq long, item long, bad boolean, t double")
        parts = scans.stretches(df, "item", ["seq"], bad=F.col("bad")).groupBy("k", "stretch").count().collect()
        hot = [p["count"] for p in parts if p.k == 1]
        assert len(hot) >= 7 and max(hot) < 2000
        levels = {r.item: (r.level, r.streak) for r in folds.rate_level(df, "item", ["seq"], F.col("bad"), most=most).collect()}
        strikes = {r.item: r.strikes for r in folds.strikes(df, "item", F.col("t"), idle=60).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in {r[1] for r in timed}:
        level = streak = n = 0
        before = None
        for _, _, bad, t in (r for r in timed if r[1] == k):
            streak += 1
            if bad:
                level, streak = min(level + 1, most), 0
            elif streak == 5:
                level, streak = max(level - 1, 0), 0
            n, before = (max(n - 1, 0) if before is not None and t - before > 60 else n) + 1, t
        assert (levels[k], strikes[k]) == ((level, streak), n)


@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-3, 3), st.integers(0, 4)), min_size=1, max_size=12))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_clamped_is_the_composition(spark, steps):
    rows = [(i, a, low, low + width) for i, (a, low, width) in enumerate(steps)]
    whole = scans.clamped(spark.createDataFrame(rows, "at long, add long, low long, high long").withColumn("g", F.lit(1)), ["g"], "at").first()
    for x in range(-8, 9):
        want = x
        for _, a, low, high in rows:
            want = min(max(want + a, low), high)
        assert min(max(x + whole["add"], whole.low), whole.high) == want


def test_empty_log(spark):
    df = spark.createDataFrame([], "seq long, item long, bad boolean, t double")
    assert folds.rate_level(df, "item", ["seq"], F.col("bad")).count() == folds.strikes(df, "item", F.col("t")).count() == 0
