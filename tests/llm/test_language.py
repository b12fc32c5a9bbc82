import zlib

from harrow.llm import language

KIND = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_calibration(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = language.query(spark, d).collect()
    assert {r.doc_id for r in rows} == set(lang) and len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held)
    assert right > 0.95
    assert abs(sum(r.score for r in held) / len(held) - right) < 0.05


def test_most_weights_are_zero(spark):
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    seen = model.ftrl.n > 0
    assert (model.dense[seen] == 0).mean() > 0.5


def test_edge_cases(spark):
    texts = {"en": "the cat and the dog went home together with them", "de": "der hund und die katze gingen nach hause über"}
    rows = [(i, f"{texts[k]} {i}", k) for i in range(60) for k in texts]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 345 !?", "de"), (None, "der hund", None), (1003, "the dog " * 40_000, None), (1003, "the dog " * 40_000, None), (1004, "²³ ½", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    got = {(r.doc_id, r.text): (r.lang_pred, r.p) for r in language.identify(df, language.fit(df), score="p").collect()}
    assert got[None, "der hund"][0] == "de" and got[1003, "the dog " * 40_000][0] == "en"
    assert all(got[k] == ("und", 0.0) for k in [(1000, None), (1001, ""), (1002, "12 345 !?"), (1004, "²³ ½")])


def test_without_rows_or_labels(spark):
    none = spark.createDataFrame([], KIND)
    assert language.fit(none) is None and language.identify(none, None).count() == 0
    bare = spark.createDataFrame([(1, "text", None, "x")], KIND)
    assert language.identify(bare, language.fit(bare)).first().lang_pred == "und"
    one = spark.createDataFrame([(i, f"text {i}", "en", "x") for i in range(9)], KIND)
    assert {r.lang_pred for r in language.identify(one, language.fit(one)).collect()} == {"en"}
