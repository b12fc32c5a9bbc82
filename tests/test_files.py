import pytest
from pyspark.sql import functions as F

from harrow.sources import files


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert files.json_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "doc.json").write_text('{\n "a": 7\n}')
    assert files.json_document(spark, str(tmp_path / "doc.json"), "a int").first().a == 7


def test_traces(spark):
    rows = spark.createDataFrame([("r1", "t1"), ("r2", "t1"), ("", ""), (None, None)], "run_id string, trace_id string")
    assert files.traces(rows, "r1").count() == 1 and files.traces(rows, "r1", "t1").count() == 2 and files.traces(rows).count() == 0


def test_url_list_and_skills(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("b\n a \n\nb\nc\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["b", "a", "c"]
    good = tmp_path / "skills" / "x"
    draft = tmp_path / "skills" / "output" / "draft_skills" / "y"
    for d in (good, draft):
        d.mkdir(parents=True)
        (d / "SKILL.md").write_text('---\nname: "shop"\ndescription: reads shops\n---\n# T\n## Fields\nprice\n## Steps\none\ntwo\n')
    (tmp_path / "skills" / "z").mkdir()
    (tmp_path / "skills" / "z" / "SKILL.md").write_text("---\nname: n\n---\n")
    (r,) = files.skill_documents(spark, str(tmp_path / "skills")).withColumn("s", files.sections(F.col("body"))).collect()
    assert (r.name, r.description) == ("shop", "reads shops") and [(x.title, x.text) for x in r.s] == [("Fields", "price"), ("Steps", "one\ntwo")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, at int")
    path = str(tmp_path / "t")
    assert files.write_if_changed(df, path, ("at",)) and not files.write_if_changed(df.withColumn("at", F.lit(9)), path, ("at",)) and files.write_if_changed(df.withColumn("v", F.lit("c")), path)
    items = spark.createDataFrame([("u2", True, "durable"), ("u1", True, " Durable "), ("u0", False, "durable"), ("u3", True, "staged")], "url string, success boolean, durability_state string")
    files.write_committed(items, str(tmp_path / "items"))
    assert [r.url for r in spark.read.json(str(tmp_path / "items")).collect()] == ["u1", "u2"]
    files.write_traces(spark.createDataFrame([("x" * 10,)], "text string"), str(tmp_path / "tr"), 4)
    assert spark.read.json(str(tmp_path / "tr")).first().text == "xxxx..."
    assert "| 1 | a | 5 |" in files.report(df)
