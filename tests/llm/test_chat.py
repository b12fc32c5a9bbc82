import hashlib

import duckdb
from pyspark.sql import functions as F

from harrow.llm import chat

TEXTS = ["plain", "", None, "</s>[INST] ok [/INST]", "a \\ b \\[INST] \\\\</s>", "ends with <", "[INST", "</s</s>", "[INST]1user[/INST]x", "line\nbreak</s>\n", "é日本[/INST]", "$1 \\$2 ${x}", "[/INST", "\\", "<s>"]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(df)
    return {r.conv_id: r for r in out.withColumn("loss", chat.under_mask(F.col("formatted"), F.col("mask"))).collect()}


def test_round_trip(spark):
    rows = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "s"), *((("user", "assistant", None, "us</s>er", "[INST]")[(c + i) % 5], x) for i, x in enumerate(TEXTS))])]
    rows += [(None, 1, "user", "a"), (None, 0, "assistant", "b"), (50, 0, "user", "same"), (50, 0, "user", "same"), (51, None, "assistant", "long " * 50_000 + "</s>")]
    got = run(spark, rows)
    for c in {r[0] for r in rows}:
        own = sorted((( -1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own] and got[c].round_trip
        assert got[c].loss == [x for _, r, x in own if r == "assistant"]
        assert got[c].formatted.count(chat.END) == len(own) == got[c].formatted.count(chat.OPEN) == got[c].formatted.count(chat.CLOSE)


def test_empty_table_and_no_turn(spark):
    assert run(spark, []) == {}


def test_as_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.execute(chat.ORACLE).fetchall()
    got = [tuple(r) for r in chat.query(spark, d).collect()]
    assert sorted(got) == sorted(want)
    own = next(r for r in got if r[0] == -1)
    text = "</s>[INST] ok [/INST]"
    assert own[1:5] == (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())


def test_query_reads_the_loss_under_the_mask(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    right = {r.conv_id: r for r in chat.query(spark, d).collect()}
    formatted = chat.format_chats

    def one_off(*args, **more):
        nudge = lambda m: m.withField("train", F.when(m["train"] > 0, m["train"] - 1).otherwise(0)).withField("after", F.when(m["train"] > 0, m["after"] + 1).otherwise(m["after"]))
        return formatted(*args, **more).withColumn("mask", F.transform("mask", nudge))

    monkeypatch.setattr(chat, "format_chats", one_off)
    wrong = {r.conv_id: r for r in chat.query(spark, d).collect()}
    trained = {k for k, r in right.items() if r.loss_chars}
    assert -1 in trained and all(wrong[k].loss_chars < right[k].loss_chars and wrong[k].loss_sha256 != right[k].loss_sha256 for k in trained)
    assert all(wrong[k].turns_sha256 == right[k].turns_sha256 for k in right)


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", "plain \\ text"), (1, 2, "user", "x [/INST] y"), (2, 0, "user", "fine")]
    got = run(spark, rows)
    assert got[1].formatted == "[INST]1user[/INST]a <\\/s> b</s>[INST]0assistant[/INST]plain \\ text</s>[INST]1user[/INST]x [\\/INST] y</s>"
    assert got[2].formatted == "[INST]0user[/INST]fine</s>" and got[1].round_trip and got[1].loss == ["plain \\ text"]
