import pytest
from pyspark.sql import functions as F

from harrow.plans import tree
from harrow.sources import files


def test_deep_trees_come_whole(spark):
    nodes = spark.range(41).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.concat(F.lit("n"), F.col("id")).alias("label"))
    rows = {r.id: r for r in tree.walk(nodes, "id", "up", "label").collect()}
    assert {k: r.depth for k, r in rows.items()} == {i: i for i in range(41)}
    assert rows[40].path == " > ".join(f"n{i}" for i in range(41))


def test_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (2, 3, "b")], "id long, up long, label string")
    with pytest.raises(Exception, match="cycle"):
        tree.walk(nodes, "id", "up", "label").collect()


def test_long_chain_in_few_jobs(spark):
    """A thousand nodes deep: a doubling a round, not a round a level."""
    sc = spark.sparkContext
    nodes = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit("n").alias("label"))
    sc.setJobGroup("chain", "")
    rows = {r.id: r for r in tree.walk(nodes, "id", "up", "label").select("id", "depth", "path").collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("chain"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {k: r.depth for k, r in rows.items()} == {i: i for i in range(1000)} and rows[999].path == " > ".join("n" * 1000)
    assert jobs < 60, jobs


def test_forest_with_orphans_and_several_parents(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, 2, "d"), (4, 3, "d"), (5, 4, "e"), (6, None, "f"), (7, 99, "x"), (8, 7, "y"), (None, 1, "n")]
    found = tree.walk(spark.createDataFrame(rows, "id long, up long, label string"), "id", "up", "label")
    assert [r.path for r in found.where("id is not null").orderBy("sort_path").collect()] == ["a", "a > b", "a > b > d", "a > b > d > e", "a > c", "a > c > d", "a > c > d > e", "f"]
    with pytest.raises(Exception, match="cycle"):
        tree.walk(spark.createDataFrame([(1, None, "a"), (2, 3, "b"), (3, 2, "c")], "id long, up long, label string"), "id", "up", "label")


def test_sections_and_report_leave_nothing_out(spark):
    body = "# T\n" + "".join(f"## s{i}\n{i}\n" for i in range(10_500))
    (r,) = spark.createDataFrame([(body,)], "body string").select(files.sections(F.col("body")).alias("s")).collect()
    assert [(x.title, x.text) for x in r.s] == [(f"s{i}", str(i)) for i in range(10_500)]
    (r,) = spark.createDataFrame([("none",), (None,)], "body string").agg(F.collect_list(files.sections(F.col("body"))).alias("s")).collect()
    assert r.s == [[]]
    assert files.report(spark.range(1000)).count("\n") == 1002
    with pytest.raises(ValueError):
        files.report(spark.range(1001))
