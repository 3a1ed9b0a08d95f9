import random

from loomgraph.operators import components
from loomgraph.operators.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_random_graphs_chain_and_star(spark):
    rng = random.Random(5)
    cases = [
        [(rng.randrange(60), rng.randrange(60)) for _ in range(40)],
        [(k, k + 1) for k in range(40)],
        [(0, k) for k in range(1, 50)],
        [(7, 7), (8, 9), (8, 9)],
    ]
    for edges in cases:
        df = spark.createDataFrame(edges, "src long, dst long")
        assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)


def test_star_rounds_agree_with_one_part(spark, monkeypatch):
    """Many parts: rounds of stars, with every node of several edges a hub."""
    monkeypatch.setattr(components, "HUB", 3)
    rng = random.Random(8)
    for edges in ([(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200, 200)], [(k, k + 1) for k in range(50)], [(0, k) for k in range(1, 60)]):
        df = spark.createDataFrame(edges, "src long, dst long").repartition(6)
        assert {r.node: r.component for r in connected_components(df, part=5).collect()} == brute(edges)


def test_names(spark):
    df = spark.createDataFrame([("b", "é"), ("é", "a"), ("x", "x")], "src string, dst string")
    assert {(r.node, r.component) for r in connected_components(df).collect()} == {("a", "a"), ("b", "a"), ("é", "a"), ("x", "x")}


def test_empty_and_null_ends(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")
    assert connected_components(df).count() == 0
