import random

from harrow.llm import suffixes


def brute(texts, least=50):
    """Word positions in runs of ``least`` words that stand at two places of the corpus."""
    seen = {}
    words = [(t or "").encode().lower().split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((d, i))
    hit = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d].update(range(i, i + least))
    return hit


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, of string, at int")
    got = {r.kept.doc_id: r for r in suffixes.repeated_passages(df).collect()}
    assert len(got) == len(texts) and all(got[i].n_words == len((t or "").encode().split()) and got[i].kept.at == 3 for i, t in enumerate(texts))
    return [{p for s in got[i].passages for p in range(s.start, s.stop)} for i in range(len(texts))]


def prose(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def test_planted_passages_are_found_exactly(spark):
    rng = random.Random(1)
    passage = [prose(rng, n) for n in (50, 51, 75, 49, 400)]
    docs = [prose(rng, rng.randrange(200)) + (passage[i % 5] if i % 3 else []) + prose(rng, rng.randrange(200)) for i in range(60)]
    docs[0] = docs[0] + passage[2] + prose(rng, 30) + passage[2]  # twice in one text
    docs[3] = [w.upper() for w in passage[0]]
    texts = [" ".join(d) for d in docs] + [None, "", "\t\n", "short text", "one two " * 40, "la " * 3000, "la " * 20_000, " ".join(docs[7]), " ".join(docs[7])]
    assert run(spark, texts) == brute(texts)


def test_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 600)
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(600)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    assert run(spark, texts) == brute(texts)


def test_partners_behind_a_hot_run(spark):
    rng = random.Random(3)
    hot = [f"hot{i}" for i in range(40)]
    docs = []
    for i in range(150):
        own = [f"own{i}x{j}" for j in range(15)]
        for side in "ab":
            mine = own + hot if i % 2 else hot + own
            docs.append([f"{side}{i}y{j}" for j in range(20)] + mine + [f"{side}{i}z{rng.randrange(10**6)}" for _ in range(20)])
    texts = [" ".join(d) for d in docs]
    texts += texts[:1] * 6 + [" ".join(hot), " ".join(hot * 3)]
    assert run(spark, texts) == brute(texts)


def test_real_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got, want = run(spark, texts), brute(texts)
    assert got == want and any(want)


def test_families_of_passages(spark):
    """Two texts share 54 words; twelve others share 60 words of one of the two."""
    rng, docs = random.Random(4), []
    for f in range(25):
        common = [f"c{f}x{j}" for j in range(54)]
        long = common[20:] + [f"l{f}x{j}" for j in range(26)]
        own = lambda n, k: [f"o{f}x{k}x{j}" for j in range(n)]  # noqa: B023, E731
        docs.append(own(rng.randrange(30), "a") + common + [f"l{f}x{j}" for j in range(26)] + own(9, "b"))
        docs.append(own(12, "c") + common + own(rng.randrange(30), "d"))
        docs += [own(rng.randrange(40), f"e{k}") + long + own(10, f"f{k}") for k in range(12)]
    texts = [" ".join(d) for d in docs]
    assert run(spark, texts) == brute(texts)


def test_as_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    rows = suffixes.query(spark, d)
    want = con.execute(suffixes.ORACLE).fetchdf()[rows.columns].values.tolist()
    assert sorted(map(list, rows.collect())) == sorted(want) and any(r[-1] for r in want)


def test_empty_table(spark):
    assert run(spark, []) == []
