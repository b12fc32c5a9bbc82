import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.functions import outcomes
from harrow.operators import schemas
from harrow.streaming import progress


def rows_of(rng, start, n):
    return [{"seq": start + i, "run": f"r{rng.randrange(6)}", "stage": rng.choice(["a", "b", "c"]), "ok": rng.random() < 0.5} for i in range(n)]


def expected(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        ok = out.get(r["run"], (0, "", 0))[2] + r["ok"]
        out[r["run"]] = (r["seq"], r["stage"], ok)
    return out


def state(spark, path):
    return {r.run: (r.seq, r.stage, r.done) for r in progress.current(spark, path, ["run"], ["seq"], ("done",)).collect()}


def test_stream_and_replayed_batches(spark, tmp_path):
    rng = random.Random(2)
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    (tmp_path / "log").mkdir()
    rows = []
    sink = progress.keyed_sink(table, ["run"], ["seq"], {"done": F.col("ok")})
    for k in range(3):
        new = rows_of(rng, 100 * k, 60)
        rows += new
        for half in range(2):
            (tmp_path / "log" / f"{k}{half}.json").write_text("\n".join(map(json.dumps, new[30 * half : 30 * half + 30])))
        stream = progress.events(spark, log, "seq long, run string, stage string, ok boolean", batch=1)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
        assert state(spark, table) == expected(rows)
    # A second group has its own offset, and a cap on its batches.
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [30] * 6
    # A batch again, and a batch that had come halfway: no second effect.
    last = spark.createDataFrame(rows[-30:], "seq long, run string, stage string, ok boolean")
    sink(last, 5)
    sink(last.limit(7), 5)
    sink(last.repartition(3), 5)
    assert state(spark, table) == expected(rows)
    progress.compact(spark, table, str(tmp_path / "small"), ["run"], ["seq"], ("done",))
    assert state(spark, str(tmp_path / "small")) == expected(rows)


def test_canonical_fields(spark):
    texts = ['{"stage": "x", "queue": {"stream_length": 3, "pending_count": 0}, "pending_count": 2, "thread_id": null, "more": 1}', "{}", None, "no json"]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "s string").select(progress.canonical("s").alias("m")).collect()]
    assert got == [{"stage": "x", "stream_length": "3", "pending_count": "2"}, {}, {}, {}]


def test_schema_drift_and_upgrade(spark):
    have = StructType.fromDDL("id int, a struct<x:int,y:array<struct<p:int>>,gone:string>, m map<string,struct<v:int>>, extra string")
    want = StructType.fromDDL("id int, a struct<x:int,y:array<struct<p:int,q:string>>,new:struct<z:int>>, m map<string,struct<v:int,w:date>>, top long")
    changes = {(r.path, r.change) for r in schemas.drift(spark, have, want).collect()}
    assert changes == {("a.gone", "added"), ("a.new", "lost"), ("a.y[].q", "lost"), ("extra", "added"), ("m{value}.w", "lost"), ("top", "lost")}
    df = spark.createDataFrame([(1, (5, [(7,), None], "g"), {"k": (3,)}, "e"), (2, None, None, None)], have)
    out = schemas.upgraded(df, want)
    assert schemas.drift(spark, out.schema, want).isEmpty() and schemas.drift(spark, have, have).isEmpty()
    first, second = (json.loads(r.j) for r in out.orderBy("id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect())
    assert first == {"id": 1, "a": {"x": 5, "y": [{"p": 7, "q": None}, None], "new": None}, "m": {"k": {"v": 3, "w": None}}, "top": None}
    assert second == {"id": 2, "a": None, "m": None, "top": None}
    retyped = StructType.fromDDL("id string, a struct<x:int>")
    assert ("id", "retyped") in {(r.path, r.change) for r in schemas.drift(spark, have, retyped).collect()}
    with pytest.raises(ValueError, match="int"):
        schemas.upgraded(df, retyped)


def test_grouping(spark):
    rows = [
        (" Category ", "Manual", "3", "10", [" a ", ""], ["x"]), ("category", "manual", "0", "-1", ["", None], [" "]), ("category", "auto", "2", None, ["a"], ["x"]), ("none", "manual", "3", "4", ["a"], ["x"]), (None, None, None, "x", None, None), ("other", "manual", "1", "2", ["a"], ["x"]), ("category", "odd", "1", "2", None, None),
    ]
    df = spark.createDataFrame(rows, "g string, d string, p string, t string, r array<string>, e array<string>")
    got = [tuple(r.s) for r in df.select(outcomes.grouping(*[F.col(c) for c in "gdptre"]).alias("s")).collect()]
    assert got == [
        ("category", 3, 10, "manual", ["a"], ["x"]), ("category", None, None, "auto", [], []), ("category", 2, None, "auto", [], ["x"]), ("none", None, 4, "auto", [], []), ("none", None, None, "auto", [], []), ("none", None, 2, "auto", [], []), ("category", 1, 2, "auto", [], []),
    ]
