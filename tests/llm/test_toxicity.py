from harrow.llm import toxicity


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    d = "/root/testdata/sf0.01"
    mark = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in toxicity.query(spark, d).collect()]
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    known = [r for r in rows if r.doc_id in mark]
    hit = [r.toxic for r in known if mark[r.doc_id]]
    false = [r.toxic for r in known if not mark[r.doc_id]]
    assert sum(hit) / len(hit) > 0.7 and sum(false) / len(false) < 0.02
    assert all(0 <= r.expected_severity <= 2 and r.toxic == (r.grade > 0) for r in rows)


def test_unseen_documents_and_order_of_grades(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    text = lambda i, n: " ".join([*(words[(i * 7 + j * 13) % 200] for j in range(30)), *["vile", "scorn", "muck"][:n] * (4 if n > 2 else 1)])
    rows = [(i, text(i, (0, 0, 1, 3)[i % 4])) for i in range(800)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 > 1)) for i in range(600)] + [(None, 1, 1), (3, 0, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.s for r in toxicity.severity(docs, model, into="s").collect()}
    mean = lambda m: sum(got[i].expected for i in range(600, 800) if i % 4 == m) / 50
    assert mean(0) < mean(2) < mean(3) and all(got[i].toxic == (i % 4 > 1) for i in range(600, 800))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3"), (None, text(3, 3)), (4, text(3, 3) * 10_000), (4, text(3, 3) * 10_000)], "doc_id long, text string")
    s = [(r.doc_id, r.severity.toxic, r.severity.expected) for r in toxicity.severity(odd, model).collect()]
    assert s[:3] == [(1, False, 0.0), (2, False, 0.0), (3, False, 0.0)] and s[3][1] and s[4] == s[5]


def test_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.severity(docs, None).first().severity.toxic is False
    assert toxicity.severity(docs.limit(0), None).count() == 0


def test_held_out_labels(spark):
    """Fitted on four fifths of the labels; precision, recall and the order of severities on the rest."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    held = labels.where("pmod(hash(doc_id), 5) = 0")
    model = toxicity.fit(docs, labels.where("pmod(hash(doc_id), 5) <> 0"), rounds=2)
    assert (model.dense == 0).mean() > 0.9
    rows = [(r.toxic, r.severity) for r in toxicity.severity(docs.join(held, "doc_id"), model).select("toxic", "severity").collect()]
    said = [(bool(t), s.toxic) for t, s in rows]
    both = sum(t and s for t, s in said)
    assert both / sum(t for t, _ in said) > 0.75 and both / sum(s for _, s in said) > 0.9
    dirty, clean = [s.expected for t, s in rows if t], [s.expected for t, s in rows if not t]
    assert sum(a > b for a in dirty for b in clean) / (len(dirty) * len(clean)) > 0.93
