from __future__ import annotations

import random

from riskloom.llm.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_random_graphs_chains_and_stars(spark):
    random.seed(3)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2000 + i) for i in range(1, 300)]
    edges += [(5, 5), (2001, 2000), (2001, 2000)]
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
