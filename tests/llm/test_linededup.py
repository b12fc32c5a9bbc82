import duckdb

from harrow.llm import linededup


def spread(where, sites):
    return {x for x, s in where.items() if len(s) >= sites}


def brute(rows, sites, own=0.5):
    trim = lambda x: x.strip(" \t\r")
    where, texts = {}, {}
    for _, t, s in rows:
        texts[t] = {trim(x) for x in (t or "").split("\n")} - {""}
        for x in texts[t]:
            where.setdefault(x, set()).add(s or "")
    wide, where = spread(where, sites), {}
    for _, t, s in rows:
        if sum(map(len, texts[t] & wide)) <= (1 - own) * sum(map(len, texts[t])):
            for x in texts[t] & wide:
                where.setdefault(x, set()).add(s or "")
    bad = spread(where, sites)
    out = []
    for k, t, _ in rows:
        parts = [] if t is None else t.split("\n")
        rest = [x for x in parts if trim(x) not in bad]
        out.append((k, len(parts), len(parts) - len(rest), None if t is None else "\n".join(rest)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, body string, n_lines int")
    got = linededup.line_dedup(df, **more).collect()
    assert all(r.kept.n_lines == 1 for r in got)
    return sorted(((r.kept.doc_id, r.n_lines, r.n_removed, r.body) for r in got), key=str)


def test_as_brute_force(spark):
    rows = [(i, f"Share this\r\n  Follow us \nown {i} {'w' * 400}\n\nspread {i % 3}\n\t" + "z" * 250, f"s{i % 9}") for i in range(90)]
    rows += [(500 + i, "one site only\none site only", "s1") for i in range(30)]
    rows += [(700, None, "s2"), (701, "", None), (None, "Share this", None), (702, "\n", "s3"), (702, "\n", "s3"), (703, "Share this\n" * 40_000, "s4"), (704, "Follow us\nShare this", "s5")]
    for sites in (3, 8, 9, 10, 1):
        assert run(spark, rows, sites=sites) == brute(rows, sites)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_many_sites_are_settled_by_the_sketch(spark):
    rows = [(i, "everywhere\n" + ("often\n" if i < 90 else "") + f"own {i} and its own words", f"s{i}") for i in range(400)]
    assert run(spark, rows, sites=100) == brute(rows, 100)


def test_copied_documents_are_no_boilerplate(spark):
    """Copies and near copies on many sites keep their lines, long or short; a long notice under unlike texts goes."""
    rows = [(i, f"a copied line\nand another, copied as well\nchanged {i if i % 2 else 0}", f"s{i}") for i in range(40)]
    rows += [(100 + i, f"{i} " + "own words " * 40 + "\n" + "This long notice stands on every site. " * 6, f"s{i}") for i in range(12)]
    got = run(spark, rows)
    assert got == brute(rows, 8)
    assert {k: n for k, _, n, _ in got} == {k: int(k >= 100) for k, *_ in rows}


def test_hot_lines_are_dealt_by_a_salt(spark, monkeypatch):
    from functools import partial

    monkeypatch.setattr(linededup, "matching", partial(linededup.matching, most=0))
    rows = [(i, f"everywhere\nown {i} and its own words\nof {i % 7}, a few", f"s{i % 30}") for i in range(300)]
    assert run(spark, rows) == brute(rows, 8)


def test_as_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.execute(linededup.ORACLE).fetchall()
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in linededup.query(spark, d).collect()]
    assert sorted(got) == sorted(want) and any(r[2] for r in got)
