import random

from factorloom.operators.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, *edges[:20], (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
