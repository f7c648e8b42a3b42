import random

from stringloom.llm.common import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 200 + i) for i in range(50)]
    others = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges = chain + star + others + [(-5, 7), (7, -5), (9, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in plain(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
