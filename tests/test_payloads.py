"""Nested JSON against recursive Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from harrow.operators import payloads

KEPT = ["usage_metadata", "token_usage", "usage", "response_metadata", "additional_kwargs"]


def value(rng, depth):
    kind = rng.randrange(9)
    if depth and kind < 4:
        return {rng.choice(["a", "b", "é", 'q"x', "usage", "token_usage", "input_tokens", "completion_tokens"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and kind == 4:
        return [value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return rng.choice([1, -7, 0, 2.5, "x", "12", ' {"a": [', "", True, None])


def whole(v):
    if isinstance(v, bool) or isinstance(v, (int, float)):
        return int(v)
    if isinstance(v, str):
        return int(v) if v.strip().lstrip("+-").isdigit() else None
    return None


def usage(v):
    level = [v]
    while level:
        for x in level:
            if isinstance(x, dict):
                first = lambda *names: next((n for k in names if (n := whole(x.get(k))) is not None), None)  # noqa: B023, E731
                p, c, t = first("prompt_tokens", "input_tokens"), first("completion_tokens", "output_tokens"), first("total_tokens")
                t = p + c if t is None and p is not None and c is not None else t
                if (p, c, t) != (None, None, None):
                    return tuple(max(0, n or 0) for n in (p, c, t))
        below = []
        for x in level:
            if isinstance(x, dict):
                below += [x[k] for k in sorted(x, key=lambda k: (KEPT.index(k) if k in KEPT else 99, k))]
            elif isinstance(x, list):
                below += x
        level = below
    return None


def merge(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def texts(rng, n):
    return [json.dumps(value(rng, 4), ensure_ascii=rng.random() < 0.5) for _ in range(n)] + ["", "{", "not json", None, "[]", "{}", "null", '"x"', "[[[1]]]", '{"a":' * 12 + "1" + "}" * 12]


def parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return ...


def test_canonical_and_ids(spark):
    rows = list(enumerate(texts(random.Random(1), 150)))
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.text for r in payloads.canonical(df.withColumnRenamed("text", "p"), ["id"], "p").collect()}
    want = {i: json.dumps(v, ensure_ascii=False, sort_keys=True) for i, t in rows if (v := parsed(t)) is not ...}
    assert got == want
    ids = {r.id: r.execution_id for r in payloads.execution_ids(df, ["id"], "text").collect()}
    assert ids == {i: hashlib.sha1(t.encode()).hexdigest()[:16] for i, t in want.items()}


def test_token_usage(spark):
    rows = list(enumerate(texts(random.Random(2), 250)))
    got = {r.id: tuple(r)[1:] for r in payloads.token_usage(spark.createDataFrame(rows, "id long, p string"), ["id"], "p").collect()}
    want = {i: u for i, t in rows if (v := parsed(t)) is not ... and (u := usage(v))}
    assert got == want and len(want) > 25


def test_merged(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(25), t) for i, t in enumerate(texts(rng, 240))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "at long, k long, p string").repartition(3)
    got = {r.k: r.text for r in payloads.merged(df, ["k"], "at", "p").collect()}
    want = {}
    for _, k, t in sorted(rows):
        v = parsed(t)
        want[k] = merge(want.get(k, {}), v if isinstance(v, dict) else {})
    assert {k: json.loads(t) for k, t in got.items()} == want
    whole = spark.createDataFrame(list(got.items()), "k long, p string")  # written once more, arrays too are in canonical form
    assert {r.k: r.text for r in payloads.canonical(whole, ["k"], "p").collect()} == {k: json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in want.items()}


def test_depth_and_empty(spark):
    df = spark.createDataFrame([('{"a":[{"b":"]}"}]}',), ("7",), ('"[["',), (None,)], "p string")
    assert [r.d for r in df.select(payloads.depth(F.col("p")).alias("d")).collect()] == [3, 0, 0, None]
    none = spark.createDataFrame([], "id long, at long, p string")
    assert payloads.canonical(none, ["id"], "p").count() == payloads.token_usage(none, ["id"], "p").count() == payloads.merged(none, ["id"], "at", "p").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_for_one_payload(spark):
    df = spark.createDataFrame([(1, '{"b": [1, {"a": null}], "a": {}}'), (1, '{"b": 1.50, "a\\"c": "x"}'), (None, "[[], [2]]")], "id long, p string")
    found = payloads.canonical(df, ["id"], "p")
    assert "Exchange" not in plan(found) and "Exchange" not in plan(payloads.execution_ids(df, ["id"], "p"))
    assert sorted(r.text for r in found.collect()) == ["[[], [2]]", '{"a": {}, "b": [1, {"a": null}]}', '{"a\\"c": "x", "b": 1.5}']  # also where the key is not unique


def test_merged_leaves(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(25), t) for i, t in enumerate(texts(rng, 240))]
    df = spark.createDataFrame(rows, "at long, k long, p string")
    found = payloads.merged_leaves(df, ["k"], "at", "p")
    assert plan(found).count("Exchange hashpartitioning") <= 2 and plan(found).count("Scan ExistingRDD") == 1  # each payload is opened once
    want = payloads.leaves(payloads.merged(df, ["k"], "at", "p"), ["k"], "text")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
