import random

from harrow.streaming import queue


def test_stream_as_batch_replay(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"item{rng.randrange(12)}", rng.choice(["push", "push", "fetch", "fetch", "ack", "fail", "fail", "release", "recover"])) for i in range(900)]
    kind = "seq long, item string, op string"
    for k in range(3):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], kind).coalesce(1).write.json(str(tmp_path / "log"), mode="append")
    log = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
    run = queue.stream(log, "item", "op", "seq").writeStream.outputMode("update").format("memory").queryName("queue_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for r in spark.table("queue_states").collect():
        last.setdefault(r.item, []).append((r.pushed + r.delivered + r.acked + r.dead + r.retries, tuple(r)))
    want = {r.item: tuple(r) for r in queue.replay(spark.createDataFrame(rows, kind), "item", "op", ["seq"]).collect()}
    assert set(last) == set(want) and all(want[k] in [t for _, t in v] for k, v in last.items())


def test_retries_then_dead_letter(spark):
    ops = ["push", "push", "fetch", "fail", "fail", "fail", "fail", "push", "fetch", "release", "fetch", "ack", "push"]
    r = queue.replay(spark.createDataFrame([(i, "a", o) for i, o in enumerate(ops)], "seq long, item string, op string"), "item", "op", ["seq"]).first()
    assert (r.state, r.dead, r.acked, r.pushed, r.delivered) == ("queued", 1, 1, 3, 3)
    assert queue.drained(spark.createDataFrame([("absent", 1)], "state string, dead int")).first().drained


def test_events_once_within_a_watermark(spark, tmp_path):
    """An event that comes again, in the same batch or a later one, is there once; one behind the watermark is dropped."""
    kind = "id string, at timestamp"
    (tmp_path / "in").mkdir()
    lines = [["a 10:00", "a 10:01", "b 10:05"], ["b 10:06", "c 13:00"], ["d 09:00", "c 13:10", "e 13:20"]]
    for k, own in enumerate(lines):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(f'{{"id": "{x[0]}", "at": "2024-01-01T{x[2:]}:00"}}' for x in own))
        log = spark.readStream.schema(kind).json(str(tmp_path / "in"))
        queue.dedup_events(log, "id", "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "e"]
