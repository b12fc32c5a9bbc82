import re

from harrow.operators import votes
from harrow.functions import xpaths
from pyspark.sql import functions as F


def run(spark, paths, **more):
    df = spark.createDataFrame([("k", i, p) for i, p in enumerate(paths)], "k string, pos int, x string")
    return [tuple(r)[1:] for r in votes.segment_consensus(df, ["k"], "x", "pos", **more).collect()]


def test_segment_consensus(spark):
    a = ["/html/body/div[1]/a", "/html/body/div[2]/a", "/html/body/div[3]/a"]
    assert run(spark, a, accept=0.3) == [("/html/body/div/a", 0.3, 3)]
    assert run(spark, a) == []
    assert run(spark, ["/a/b[2]", "/a/b[2]", "/a/b[5]", "/a/b/c/d"], majority=0.6) == [("/a/b[2]", 0.7667, 3)]
    assert run(spark, ["/a/b[2]", "/a/b[2]", "/a/b[5]"], majority=1.0, accept=0.1) == [("/a/b", 0.3, 3)]
    assert run(spark, ["/a/b", "/a/c"], accept=0.0) == []
    assert run(spark, ["//ul[@id='m'][1]/li[@class='x']", "//ul[@id='m'][1]/li[@class='x'][4]"], accept=0.1)[0][0] == "//ul[1][@id='m']/li[@class='x']"


def test_segments_and_chains(spark):
    df = spark.createDataFrame([("//ul[@id='m'][2]/li", "/a | /b ", ["/b", "x", "/c"])], "x string, u string, f array<string>")
    r = df.select(xpaths.segments("x").alias("s"), xpaths.chain(F.col("u"), F.col("f")).alias("c"), xpaths.ancestors(F.lit("/a/b[1]/c")).alias("n"), xpaths.literal(F.lit("it's \"x\"")).alias("l"), xpaths.clean(F.lit("xpath='/a/b'")).alias("q")).first()
    assert [(s.separator, s.tag, s["index"], s.attributes) for s in r.s] == [("//", "ul", 2, ["[@id='m']"]), ("/", "li", None, [])]
    assert r.c == ["/a", "/b", "/c"] and r.n == ["/a/b[1]/c", "/a/b[1]", "/a"] and r.q == "/a/b"
    assert r.l == "concat('it', \"'\", 's \"x\"')"


def test_exact_vote_prefers_support_then_stability(spark):
    df = spark.createDataFrame([("k", i, p) for i, p in enumerate(["/a[1]", "//*[@id='q']", "/a[1]", "//*[@id='q']", "/c"])], "k string, pos int, x string")
    r = votes.exact_vote(df, ["k"], "x", "pos").first()
    assert (r.x, r.support, r.dominant, r.fallbacks) == ("//*[@id='q']", 2, False, ["/a[1]", "/c"])


def count(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_a_step_splits_its_path_once(spark):
    df = spark.createDataFrame([("//ul[@id='m'][2]//li/*",), (" /a/b[1] | //div ",), ("//*[@data-x='1']/a//b",), ("",), (None,)], "x string")
    found = df.select(xpaths.steps("x").alias("s"), xpaths.over_broad("x").alias("b"))
    assert count(df.select(xpaths.steps("x").alias("s")), "split(x") + count(df.select(xpaths.steps("x").alias("s")), "split(trim(x") <= 1
    rows = found.collect()
    assert [(s.separator, s.tag, s.predicates) for s in rows[0].s] == [("//", "ul", ["@id='m'", "2"]), ("//", "li", []), ("/", "*", [])]
    assert [r.b for r in rows] == [False, True, False, True, True]


def test_consensus_reads_its_rows_once(spark, tmp_path):
    paths = ["/html/div[1]/a"] * 3 + ["/html/div[2]/a", " /html/div[2]/a ", "x", "", None]
    spark.createDataFrame([(k, i, p) for k in "ab" for i, p in enumerate(paths)], "k string, pos int, x string").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    found = votes.segment_consensus(df, ["k"], "x", "pos", accept=0.3)
    assert str(tmp_path / "p") not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", "/html/div/a", 0.3, 5), ("b", "/html/div/a", 0.3, 5)]


def test_suffixes_of_different_paths(spark):
    df = spark.createDataFrame([("k", p) for p in ["/a/ul/li[1]", "/a/ul/li[1]", " /b/ul/li", "//ul/li"]] + [("n", "/a/b"), ("n", None)], "k string, x string")
    found = votes.suffix_consensus(df, ["k"], "x")
    assert [tuple(r) for r in found.collect()] == [("k", "//ul/li")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate[^\n]*\n(?:[^\n]*(?:Project|Filter)[^\n]*\n)*[^\n]*Aggregate", plan)  # paths are aggregated below the place where they are parsed


def test_confidence_at_a_half(spark):
    rows = [("k", i, f"/a/b[{1 if i < 429 else 2}]") for i in range(528)]  # 0.7 * 429 / 528 + 0.3 = 0.86875
    found = votes.segment_consensus(spark.createDataFrame(rows, "k string, pos int, x string"), ["k"], "x", "pos")
    assert [tuple(r) for r in found.collect()] == [("k", "/a/b[1]", 0.8688, 528)]
