"""Connected components on chains, stars, cycles and nothing."""

import random

from tickframe.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, 1000 + k) for k in range(1, 300)] + [(7, 8), (8, 9), (9, 7), (5, 6), (6, 5), (5, 6)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = [e for e in edges if e[0] != e[1]]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
