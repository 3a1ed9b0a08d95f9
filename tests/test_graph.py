"""Cycles and chains of any length, by one task and by rounds."""

import random

import pytest

from loomgraph.operators import diff, findings, graph, search


def strong_sets(edges):
    """By closure: the definition."""
    nodes = {x for e in edges for x in e}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    sets = {frozenset(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    return {s for s in sets if len(s) > 1 or any((x, x) in edges for x in s)}


def found(df):
    rows = df.collect()
    assert all(r.cycle == min(r.members) for r in rows)
    return {frozenset(r.members) for r in rows}


@pytest.mark.parametrize("small", [graph.SMALL, 0, 9])
def test_cycles(spark, small):
    rng = random.Random(3)
    for edges in ([(rng.randrange(16), rng.randrange(16)) for _ in range(22)], [(1, 2), (2, 1), (2, 2), (3, 3), (4, 5), (None, 4)]):
        df = spark.createDataFrame(edges, "src long, dst long")
        assert found(graph.cycles(df, small)) == strong_sets({(a, b) for a, b in edges if a is not None})


def test_long_cycles_and_chains(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 700, "x") for k in range(700)], "src long, dst long, via string")
    assert found(graph.cycles(ring)) == {frozenset(range(700))}
    assert [r.dst for r in graph.shortest_path(ring, 5, 405).orderBy("step").collect()] == list(range(6, 406))
    nine = ring.where("src < 9").selectExpr("src", "dst % 9 as dst", "via")
    assert found(graph.cycles(nine, 0)) == {frozenset(range(9))}


@pytest.mark.parametrize("small", [graph.SMALL, 0])
def test_the_smallest_of_equal_chains(spark, small):
    df = spark.createDataFrame([("a", "c", "y"), ("a", "b", "x"), ("b", "d", "z"), ("b", "d", "w"), ("c", "d", "a"), ("a", "a", "q")], "src string, dst string, via string")
    assert [tuple(r) for r in graph.shortest_path(df, "a", "d", small).orderBy("step").collect()] == [(1, "a", "b", "x"), (2, "b", "d", "w")]
    assert graph.shortest_path(df, "d", "a", small).count() == graph.shortest_path(df, "a", "a", small).count() == 0
    assert [r.direction for r in graph.trace_path(df, "d", "a").collect()] == ["reverse"] * 2


def test_long_rings_with_tails_by_rounds(spark, monkeypatch):
    """A ring of 3000 with chords' worth of side chains, rings beside it, and paths in and out."""
    n = 3000
    ring = [(k, (k + 1) % n) for k in range(n)]
    side = [(10, n + 1), *((n + k, n + k + 1) for k in range(1, 200)), (n + 200, 20)]
    out = [(500, 2 * n), *((2 * n + k, 2 * n + k + 1) for k in range(300))]
    own = [(3 * n + k, 3 * n + (k + 1) % 77) for k in range(77)]
    df = spark.createDataFrame(ring + side + out + own, "src long, dst long")
    cuts = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": (cuts.append(name), real(df, name))[1])
    got = found(graph.cycles(df, 0))
    assert got == {frozenset(range(n)) | frozenset(range(n + 1, n + 201)), frozenset(range(3 * n, 3 * n + 77))} and len(cuts) < 60


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_by_rounds_equal_those_of_one_task(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice("abc")) for _ in range(50)]
    at = 100
    for _ in range(8):  # long chains between nodes of the graph
        long, a, b = rng.randrange(1, 12), rng.randrange(40), rng.randrange(40)
        edges += [(a, at, "x")] + [(at + k, at + k + 1, rng.choice("yz")) for k in range(long)] + [(at + long, b, "x")]
        at += 100
    df = spark.createDataFrame(edges, "src long, dst long, via string")
    for source, target in [(edges[0][0], edges[40][1]), (edges[3][0], edges[-1][1]), (edges[5][0], 103)]:
        rows = lambda small: [tuple(r) for r in graph.shortest_path(df, source, target, small).orderBy("step").collect()]
        assert rows(0) == rows(graph.SMALL)


def test_a_chain_of_many_steps_by_rounds(spark, monkeypatch):
    n = 4000
    edges = [(k, k + 1, "x") for k in range(n)] + [(k, n + 10 + k, "y") for k in range(0, n, 400)] + [(0, n + 5000, "z"), (n + 5000, 3, "z")]
    cuts = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": (cuts.append(name), real(df, name))[1])
    got = [tuple(r) for r in graph.shortest_path(spark.createDataFrame(edges, "src long, dst long, via string"), 0, n, 0).orderBy("step").collect()]
    assert got == [(1, 0, n + 5000, "z"), (2, n + 5000, 3, "z")] + [(k, k, k + 1, "x") for k in range(3, n)] and len(cuts) <= 60


def test_a_bound_raises(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.reach(edges, spark.createDataFrame([(0,)], "start long"), rounds=5)
    assert graph.reach(edges, spark.createDataFrame([(0,)], "start long")).agg({"depth": "max"}).first()[0] == 12


def test_gates_without_a_baseline(spark):
    checks = spark.createDataFrame([(True,), (True,)], "ok boolean")
    gates = diff.run_gates(checks=checks)
    assert {(r.gate, r.status) for r in gates.collect()} == {("doctor", "pass"), ("baseline", "warn")}
    assert [tuple(r) for r in diff.verify(gates, strict=True).collect()] == [("warn", 1)] and diff.verify(gates).first().exit_code == 0


def test_plan_skips_what_does_not_fit(spark):
    tasks = spark.createDataFrame([("a", "k", "w", "s", 1.0, 50.0, "low", 0.5), ("b", "k", "w", "s", 1.0, 70.0, "low", 0.6), ("c", "k", "w", "t", 1.0, 45.0, "low", 0.2), ("d", "k", "w", "t", 1.0, 5.0, "high", 0.9), ("e", "k", "w", "t", 1.0, 5.0, "low", 0.0)],
                                  "id string, kind string, workflow string, signal string, new_value double, effort double, risk string, lift double")
    signals = spark.createDataFrame([("w", "s", 0.5, 1.0), ("w", "t", 0.0, 1.0)], "workflow string, signal string, value double, weight double")
    chosen, after = findings.plan_improvements(tasks, signals, 100.0)
    assert {r.id for r in chosen.collect()} == {"a", "c"}
    assert [(r.before, r.after) for r in after.collect()] == [(0.25, 1.0)]


def test_claims(spark):
    text = "src/a.js imports `lib/b.ts`, as wf:bin:src/a.js shows; see 0123abcd."
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(search.workflow_claims(df.t).alias("w"), search.relation_claims(df.t).alias("r"), search.id_claims(df.t).alias("i")).first()
    assert r.w == ["wf:bin:src/a.js"] and [(x["from"], x["to"]) for x in r.r] == [("src/a.js", "lib/b.ts")] and r.i == ["0123abcd"]
