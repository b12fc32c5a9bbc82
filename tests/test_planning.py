"""Sinks that replace, windows of streams, outlines and functions without a query."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harrow.functions import outcomes, signatures, states, text, urls, xpaths
from harrow.operators import dispatch, evaluate, fields, history, items, lookups, merge, pages, planning, votes
from harrow.plans import tree
from harrow.sources import files
from harrow.streaming import queue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_table_is_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "t0", "u0"), (2, "b", "t0", "u0")], "k int, v string, created_at string, updated_at string")
    assert files.write_idempotent(rows, path, ["k"]) and not files.write_idempotent(rows.withColumn("updated_at", F.lit("u1")), path, ["k"])
    changed = spark.createDataFrame([(1, "a", "t1", "u1"), (2, "c", "t1", "u1"), (3, "d", "t1", "u1")], rows.schema)
    assert files.write_idempotent(changed, path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", "t0", "u0"), (2, "c", "t0", "u1"), (3, "d", "t1", "u1")]
    files.replace_table(spark.read.parquet(path).where("k > 1"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_staged_output_is_promoted(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "staged"))
    files.promote(spark, str(tmp_path / "staged"), str(tmp_path / "deep" / "final"))
    assert spark.read.json(str(tmp_path / "deep" / "final")).count() == 3 and not (tmp_path / "staged").exists()
    with pytest.raises(OSError):
        files.promote(spark, str(tmp_path / "none"), str(tmp_path / "deep" / "final"))
    assert spark.read.json(str(tmp_path / "deep" / "final")).count() == 3


def test_merged_results_keep_plan_order(spark, tmp_path):
    found = spark.createDataFrame([("s2", 1, "c"), ("s1", 2, "b"), ("s1", 1, "a"), ("s9", 1, "x")], "subtask string, pos int, v string")
    plan = spark.createDataFrame([("s1", 0), ("s2", 1)], "subtask string, n int")
    for _ in range(2):
        files.write_merged(found, plan, str(tmp_path / "m"), "subtask", "n", "pos")
    rows = [json.loads(x) for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(r["v"], r["plan_order"]) for r in rows] == [("a", 0), ("b", 0), ("c", 1)]


def test_scenarios(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("scenario:\n  id: shop\nground_truth:\n  file: t.jsonl\n  match_key: name\n  field_matching:\n    price: numeric\nthresholds:\n  max_steps: 9\n")
    r = files.scenarios(spark, [str(tmp_path / "a.yaml")]).first()
    assert (r.id, r.truth, r.match_key, r.field_matching, r.min_record_recall, r.min_field_f1, r.max_steps) == ("shop", "t.jsonl", "name", {"price": "numeric"}, 0.8, 0.7, 9)
    (tmp_path / "b.json").write_text('{"id": "x"}')
    with pytest.raises(ValueError):
        files.scenarios(spark, [str(tmp_path / "b.json")])


def run_stream(spark, tmp_path, make, batches, kind):
    """The rows that an append-mode query gives for batches that arrive one after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(i)))

    def source(name):
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / name))

    q = make(source).writeStream.outputMode("append").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table("windows_out").collect()), key=str)


def at(minute, hour=10):
    return datetime(2024, 1, 1, hour, minute)


KIND = "at timestamp, k string"


def test_sessions_and_late_rows(spark, tmp_path):
    batches = [[(at(0), "a"), (at(10), "a"), (at(50), "a"), (at(5), "b")], [(at(0, 15), "a")], [(at(1, 15), "z")], [(at(1), "a"), (at(0, 18), "z")], [(at(0, 22), "z")]]
    got = run_stream(spark, tmp_path, lambda source: queue.sessions(source("in"), "at", "k"), batches, KIND)
    assert sorted((r[0], r[2], r[3]) for r in got if r[2] != "z") == [(at(0), "a", 2), (at(5), "b", 1), (at(50), "a", 1), (at(0, 15), "a", 1)]  # the row of 10:01 comes after the watermark


def test_sliding_windows(spark, tmp_path):
    batches = [[(at(0), "a"), (at(7), "a")], [(at(0, 14), "z")], [(at(1, 14), "z")], [(at(1), "a"), (at(0, 16), "z")]]
    got = run_stream(spark, tmp_path, lambda source: queue.sliding(source("in"), "at", "k"), batches, KIND)
    assert sorted((r[0], r[2]) for r in got if r[1] == "a") == [(datetime(2024, 1, 1, 9, 55), 1), (at(0), 2), (at(5), 1)]


def test_streams_are_matched(spark, tmp_path):
    spark.createDataFrame([(at(3), "a"), (at(30), "a"), (at(2), "b")], KIND).coalesce(1).write.json(str(tmp_path / "right"))
    got = run_stream(spark, tmp_path, lambda source: queue.matched(source("in"), source("right"), "k", "at").select(F.col("a.k"), F.col("a.at").alias("l"), F.col("b.at").alias("r")), [[(at(0), "a"), (at(5), "b")]], KIND)
    assert got == [("a", at(0), at(3))]


def test_tasks_to_be_tried_again_come_first(spark):
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "id int")
    got = queue.next_tasks(rows(9, 8), rows(5), rows(1, 2, 3), ["id"], 4)
    assert [(r.source, r.id) for r in got.orderBy("source", "id").collect()] == [(0, 8), (0, 9), (1, 5), (2, 1)]


def test_broad_paths(spark):
    broad = ["", "a/b", "//*", "//*[@name='x']", "//span", "//main//div", "/html//div/a", "//*[@id='x'] | //span", "//div[@id='x']//*", "//DIV", "//ul//li[2]/a"]
    fine = ["//*[@id='x']", "/html/body/div", "//*[@class='c']/a", "//div[@id='x']//a", "//ul[contains(@class, 'l')]//li", "//*[@data-k='a/b']//p", "//a", "//span[1]", "//*[@id='x'] | /html/body/p"]
    rows = spark.createDataFrame([(x, x in broad) for x in broad + fine], "x string, broad boolean")
    assert [r.x for r in rows.where(xpaths.over_broad("x") != F.col("broad")).collect()] == []
    (s,) = spark.createDataFrame([("/html//div[@a='x/y'][2]/*[@id='q']/text()",)], "x string").select(xpaths.segments("x").alias("s")).collect()
    assert [(t.separator, t.tag, t["index"], t.attributes) for t in s.s] == [("/", "html", None, []), ("//", "div", 2, ["[@a='x/y']"]), ("/", "*", None, ["[@id='q']"]), ("/", "text()", None, [])]


def test_types_of_values(spark):
    numbers = ["12", "-3.5 kg", "EUR 1,200.50", "+7", "1 000"]
    none = ["", "a", "1-2", "--3", "3 of 4", "+ x 5"]
    for v in numbers + none:
        assert one(spark, text.semantic_type_ok(F.lit(v), F.lit("number"))) == (v in numbers), v
    for v, ok in (("2024-01-05", True), ("5/12", True), ("2024年3月", True), ("2024", False), ("a-b", False)):
        assert one(spark, text.semantic_type_ok(F.lit(v), F.lit("Date "))) == ok, v


def test_templates_and_outlines(spark):
    values = F.create_map(F.lit("a"), F.lit("$1\\x"), F.lit("b.c"), F.lit(None).cast("string"))
    assert one(spark, text.render(F.lit("{{a}}-{{ a }}{{b.c}}{{bxc}}"), values)) == "$1\\x-$1\\x{{bxc}}"
    page = {"role": "WebArea", "name": "P", "children": [{"role": "generic", "children": [{"role": "tab", "name": "T", "selected": True, "expanded": False}, {"role": "text", "name": "x" * 300}]}, {"role": "button", "name": "B", "disabled": True}]}
    got = one(spark, text.outline(F.lit(json.dumps(page))))
    assert got == ['webarea "P"', '  tab "T" [selected, collapsed]', '  "' + "x" * 197 + '..."', '  button "B" [disabled]']
    assert one(spark, text.outline(F.lit("no"))) is None and len(one(spark, text.outline(F.lit(json.dumps(page)), most=2))) == 2


def test_fuzzy_search_is_ranked(spark):
    html = "<body><p>red shoes</p><script>red shoes</script><p>red shoos</p><b>green hat and a long text that is far away</b></body>"
    found = pages.nodes(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html")
    got = pages.ranks(pages.search(found, F.lit("Red  shoes"), "fuzzy", 0.8), "id", fuzzy=True).orderBy("rank").collect()
    assert [(r.text, round(r.similarity, 3)) for r in got] == [("red shoes", 1.0), ("red shoos", 0.889)]
    assert [r.text for r in pages.ranks(pages.search(found, F.lit("red")), "id").orderBy("rank").collect()] == ["red shoes", "red shoos"]
    with pytest.raises(ValueError):
        pages.step_regex("//a[last()]")


def test_new_task_without_a_signature_is_an_error(spark):
    rows = spark.createDataFrame([(1, "")], "k int, semantic_signature string")
    known = rows.where("k < 0")
    with pytest.raises(Exception, match="missing_semantic_signature"):
        planning.with_signature(rows, known, ["k"], F.lit(False), F.lit("x")).collect()


def test_history_and_merges(spark):
    tasks, runs = spark.createDataFrame([(1, "u"), (2, "v")], "t int, url string"), spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 12, 7)], "t int, r int, at int")
    assert [r.r for r in history.runs_of_url(tasks, runs, "t", "url", "u", "at", "r").collect()] == [11, 10]
    tickets = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"a": "z"})], "k int, labels map<string,string>")
    assert [r.k for r in history.with_labels(tickets, {"a": "x"}).collect()] == [1]
    known = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(r.v for r in merge.append_new(known, spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], known.schema), ["k"], [F.col("v")]).collect()) == ["a", "c"]
    assert one(spark, merge.deep_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2)))) == {"a": 1, "b": 2}
    step = lambda c, d, w, by: one(spark, merge.claim_step(*map(F.lit, (c, d, w, by))))["result"]
    assert [step("pending", "staged", "", "w"), step("claimed", "staged", "o", "w"), step("claimed", "durable", "w", "w")] == ["claimed", "claimed_by_other", "already_final"]


def test_dispatch_and_evaluation(spark):
    tickets = spark.createDataFrame([(1, "queued"), (2, "completed")], "k int, status string")
    assert [r.status for r in dispatch.cancel(tickets, F.lit(True)).orderBy("k").collect()] == ["cancelled", "completed"]
    aged = spark.createDataFrame([(1, "completed", at(0)), (2, "completed", at(59)), (3, "queued", at(0))], "k int, status string, u timestamp")
    assert [r.k for r in dispatch.unexpired(aged, "status", "u", F.lit(at(1, 11))).orderBy("k").collect()] == [2, 3]
    r = evaluate.overall(spark.createDataFrame([([], 0.5, "3"), (["x"], 1.0, "n/a")], "reasons array<string>, f1 double, steps string"), "reasons", "f1", "steps").first()
    assert (r.passed, r.failed, r.avg_f1, r.avg_steps) == (1, 1, 0.75, 3.0)
    cards = spark.createDataFrame([("k", "A", 1, 1), ("k", " a", 3, 2), ("k", "b", 2, 3)], "k string, l string, s int, p int")
    assert [(r.l, r["rank"]) for r in lookups.rank_candidates(cards, "k", F.col("l"), F.col("s"), [F.col("p")], 5).orderBy("rank").collect()] == [(" a", 1), ("b", 2)]


def test_rules_and_names(spark):
    checks = {
        True: [votes.prefers_union(F.lit(0.8), F.lit(0.5)), outcomes.finalized(F.lit("staged"), F.lit(" Acked")), outcomes.rate_limited(F.lit("Too many requests"), F.lit("")), tree.same_group(F.array(F.lit("g"), F.lit("x")), F.array(F.array(F.lit("g"), F.lit("y"))))],
        False: [votes.prefers_union(F.lit(0.8), F.lit(0.6)), outcomes.finalized(F.lit("staged"), F.lit("claimed")), outcomes.rate_limited(F.lit("fine"), F.lit("https://h.org/4")), states.selected(F.lit(None).cast("map<string,string>"))],
    }
    for want, columns in checks.items():
        assert [one(spark, c) for c in columns] == [want] * len(columns)
    assert one(spark, text.preview(F.array(*map(F.lit, "abcd")), 2)) == "a、b等" and one(spark, text.joined_reason(F.array(F.lit(" "), F.lit("x"), F.lit("y")), "none")) == "x; y"
    assert one(spark, text.variants(F.lit("Shoes (red)"))) == ["Shoes (red)", "Shoes"] and one(spark, text.blank_to_null(F.lit("  "))) is None
    assert one(spark, text.string_map(F.create_map(F.lit("a"), F.lit(" x "), F.lit("b"), F.lit(" ")))) == {"a": "x"}
    assert [one(spark, tree.node_type(F.lit(a), F.lit(b))) for a, b in ((True, "category"), (True, "stateful_list"), (False, "odd"))] == ["leaf", "stateful_list", "category"]
    assert one(spark, signatures.semantic_state(F.lit("u"), F.create_map(F.lit("k"), F.lit(" A ")))) == "u::A"
    steps = F.array(F.create_map(F.lit("action"), F.lit("click")), F.create_map(F.lit("action"), F.lit(" ")))
    assert one(spark, signatures.page_state(F.lit("u"), steps)).startswith("u#") and one(spark, signatures.page_state(F.lit("u"), F.slice(steps, 2, 1))) == "u"
    rows = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "k int, t array<string>")
    assert [r.k for r in items.requested_only(rows, F.col("t"), F.array(F.lit("c"))).collect()] == [2]
    assert one(spark, urls.page_parameter(F.lit("https://h.org/a?page=3"))) is not None


def test_fallback_chain_takes_the_first_single_value(spark):
    values = spark.createDataFrame([(1, 0, "/a", "x"), (1, 0, "/a", "y"), (1, 1, "/b", "7"), (1, 2, "/c", "8")], "k int, pos int, x string, v string")
    r = pages.first_success(values, "k", "pos", "x", "v", F.lit("number")).first()
    assert (r.x, r.value, r.attempts) == ("/b", "7", 3)


def test_navigation_paths(spark):
    rows = spark.createDataFrame([(1, 0, [("/b", 2), ("/a", 1)], True), (1, 1, [("/c", None)], True), (1, 2, [("/d", 0)], False)], "k int, step int, c array<struct<xpath:string,priority:int>>, ok boolean")
    assert sorted(map(tuple, fields.navigation_paths(rows, "k", "step", "c", F.col("ok")).collect())) == [(1, 0, "/a"), (1, 1, "/c")]
