import zlib

from harrow.llm import sharding


def run(spark, rows, shards):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, h string, size int")
    got = sharding.shard(df, shards).collect()
    assert sorted((str(r.doc_id), r.text_crc32, r["size"]) for r in got) == sorted((str(k), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for k, t in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    return got


def sums(got, shards):
    return [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]


def test_sizes_are_near_equal_with_a_hot_group(spark):
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(2000)] + [(5000 + i, "copy " * 9) for i in range(1500)]
    got = run(spark, rows, 8)
    n = sums(got, 8)
    assert max(n) - min(n) < 0.03 * sum(n) / 8


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3} and more") for i in range(3000)]
    got = run(spark, rows, 8)
    of = {}
    for r in got:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())


def test_nulls_repeats_and_few_rows(spark):
    run(spark, [(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 100_000), (3, None)], 24)
    run(spark, [(i, "same") for i in range(50)], 3)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_go_where_the_splitters_say(spark):
    """Brute force: the shard of a row is the number of splitters at or before its (hash, tie), whatever the partitions."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"text {i} " * (1 + i % 5) if i % 3 else "hot", f"n{i}") for i in range(900)], "doc_id long, text string, slot string")
    keyed = rows.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2).alias("h"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("tie"), (F.octet_length("text") + 8).cast("long").alias("size"))
    cuts = sharding.splitters(keyed, 6)
    want = {r.doc_id: sum((h, t) <= (r.h, r.tie) for h, t in cuts) for r in keyed.collect()}
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sharding.shard(rows, 6, keep=("slot", "text")).collect()
            own = {k: s for k, s in ((r.doc_id, r.shard) for r in got)}
            assert all(abs(own[k] - want[k]) <= 1 for k in want) and sum(own[k] != want[k] for k in want) <= (0 if n == "3" else 30)
            n_bytes = sums(got, 6)
            assert max(n_bytes) - min(n_bytes) < 0.05 * sum(n_bytes) / 6 and all(r.text for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
