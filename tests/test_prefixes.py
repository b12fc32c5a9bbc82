import random

import pytest

from harrow.operators import prefixes


def brute(texts, marks, least, share, scoped):
    plain = lambda s: "".join((s or "").split()).lower()
    out = []
    for key, page, text in texts:
        own, best, found = plain(text), 0, []
        for mark, on, other in marks:
            if scoped and on != page:
                continue
            n = 0
            for a, b in zip(own, plain(other), strict=False):
                if a != b:
                    break
                n += 1
            if n > best:
                best, found = n, []
            if n and n == best:
                found.append(mark)
        if own and best >= max(least, int(len(own) * share), 1):
            out.append((key, best, len(found), min(found)))
    return sorted(out)


@pytest.mark.parametrize(("least", "share", "scoped", "chunk"), [(1, 0.0, False, 4), (8, 0.4, False, 64), (3, 0.2, True, 5), (1, 0.0, True, 1)])
def test_as_brute_force(spark, least, share, scoped, chunk):
    rng = random.Random(chunk)
    words = lambda n: " ".join(rng.choice(["ab", "abc", "B", "Abcd", "x"]) for _ in range(rng.randrange(n)))
    marks = [(i, rng.randrange(3), words(12)) for i in range(60)] + [(100 + i, 1, "same beginning of all " + str(i % 3)) for i in range(30)] + [(200, 1, None), (201, 2, "  "), (202, 0, "y" * 500)]
    texts = [(i, rng.randrange(3), words(14)) for i in range(80)] + [(300 + i, 1, f"Same begin\tning of ALL {i}") for i in range(5)] + [(400, 1, None), (401, 1, ""), (402, 0, "y" * 499), (403, 0, "y" * 600), (403, 0, "y" * 600), (404, 0, marks[3][2])]
    t = spark.createDataFrame(texts, "id long, page int, text string")
    m = spark.createDataFrame(marks, "id long, page int, text string")
    out = prefixes.longest_shared(t, m, "id", "text", "id", "text", ["page"] if scoped else None, least, share, chunk)
    assert sorted((r.id, r.shared, r.marks, r.mark) for r in out.collect()) == brute(texts, marks, least, share, scoped)
    assert prefixes.longest_shared(t, m.limit(0), "id", "text", "id", "text").count() == prefixes.longest_shared(t.limit(0), m, "id", "text", "id", "text").count() == 0
