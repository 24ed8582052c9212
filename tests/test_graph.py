import random

from paperloom.operators.graph import components


def brute(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_chains_stars_and_random(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 120)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7), (1, 2)]
    nodes = sorted({n for e in edges for n in e} | {9999})
    got = {r.node: r.root for r in components(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == brute(nodes, edges)


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node int")
    assert {(r.node, r.root) for r in components(nodes, spark.createDataFrame([], "a int, b int")).collect()} == {(1, 1), (2, 2)}
    assert components(nodes.limit(0), spark.createDataFrame([], "a int, b int")).count() == 0
