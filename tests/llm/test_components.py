import random

import pytest

from harrow.llm.common import components


def brute(links):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(900, i) for i in range(200)] + [(7000, 7001)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1, 2), (2, 1), (1, 2)],
        "none": [],
    }[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute([x for x in links if x[0] != x[1]])
