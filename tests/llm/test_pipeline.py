"""Each stage of the pipeline on real documents, against brute force on what its predecessor kept."""

import corpus_pipeline as P

from . import test_decontaminate, test_linededup, test_neardup, test_packing

SF = "/root/testdata/sf0.001"
KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]

    def run(name, before):
        out = stages[name](spark, spark.createDataFrame(before, docs.schema), SF)
        if name != "packing":
            assert out.columns == KEPT
        return out.collect()

    rows = docs.collect()
    told = run("language_id", rows)
    assert set(told) <= set(rows) and len(told) > 0.95 * len(rows)

    clean = run("line_dedup", told)
    want = {k: t for k, _, n, t in test_linededup.brute([(r.doc_id, r.text, r.source) for r in told], 8) if not n or t.strip()}
    assert {r.doc_id: r.text for r in clean} == want and all(r.n_chars == len(r.text) for r in clean)

    single = run("near_dedup", clean)
    assert sorted(r.doc_id for r in single) == sorted(k for k, _, _, kept in test_neardup.brute([(r.doc_id, r.text) for r in clean], 5, 80) if kept)

    pure = run("decontamination", single)
    assert sorted(r.doc_id for r in pure) == sorted(r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in single], items) if not r[-1])

    test_packing.check(run("packing", pure), [(r.doc_id, r.text) for r in pure])


def test_stages_on_odd_rows(spark):
    """Null and empty texts, repeated rows, extra columns named as the results, no labels, empty tables: no stage fails or loses a clean document."""
    d = f"{SF}"
    extra = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, __score double, kept int, body string, items int, n_words int, spans int, row long, __row long"
    rows = [(i, f"a few own words of number {i} and more", None, None, 30, "x", 0.5, 1, "b", 2, 3, 4, 5, 6) for i in range(3)]
    rows += [rows[0], (None, None, None, None, None, *rows[0][5:]), (7, "", None, "s", 0, *rows[0][5:])]
    df = spark.createDataFrame(rows, extra)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns and set(rows[:3]) <= set(map(tuple, out.collect())), name
        assert stage(spark, df.limit(0), d).collect() == [], name
    assert {r.doc_id for r in P.pack(spark, df, d).collect()} == {0, 1, 2, 7, None} and P.pack(spark, df.limit(0), d).count() == 0
