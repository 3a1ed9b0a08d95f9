"""Closures under changes against a new closure, the index against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import closure, graph, search
from loomgraph.operators.index import SearchIndex


@pytest.mark.parametrize("seed", range(4))
def test_closure_after_changes(spark, seed):
    rng = random.Random(seed)
    edge = lambda: (rng.randrange(25), rng.randrange(25))
    edges = [edge() for _ in range(45)] + [(k, k + 1) for k in range(30, 42)]
    starts = [0, 1, 2, 30]
    table = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    first = lambda rows: spark.createDataFrame([(s,) for s in rows], "start long")
    held = graph.reach(table(edges), first(starts))
    for _ in range(2):
        removed, added = rng.sample(edges, 8) + [(99, 98)], [edge() for _ in range(5)] + [(41, 3)]
        after = sorted((set(edges) - set(removed)) | set(added))
        new, gone = [rng.randrange(25)], [starts[0]]
        now = sorted((set(starts) - set(gone)) | set(new))
        got = closure.maintain(held, table(edges), table(added + [(None, 1)]), table(removed), first(new), first(gone))
        want = graph.reach(table(after), first(now))
        assert sorted(tuple(r) for r in got.select("start", "node", "depth").collect()) == sorted(tuple(r) for r in want.collect())
        held, edges, starts = got, after, now


def test_nothing_changes_nothing(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    starts = spark.createDataFrame([(1,)], "start long")
    none = edges.where("false")
    got = closure.maintain(graph.reach(edges, starts), edges, none, none)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


WORDS = ["login", "log", "session", "userSession", "sess", "billing", "bill", "x", "a_b", "#tag", "in"]


def test_index_equals_the_scan(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", "/", ".", "-", ""]) for _ in range(rng.randrange(n)))
    rows = [(k, text(6), text(4), rng.choice([None, "", text(3)])) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, function string, file string, calls string")
    weights = {f: search.FIELD_WEIGHTS[f] for f in ("function", "file", "calls")}
    asked = ["login session", "userSession", "in", "log log", "sess/bill", "nothing here", "x", "", None, "a_b #tag", "session.log", "loginsession"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = SearchIndex.build(df, "k", tuple(weights))
    got = {(r.query_id, r.key): (r.score, r.matches) for r in index.search(queries, weights).collect()}
    want = {}
    for n, query in enumerate(asked):
        for r in search.search(df, query or "", weights).collect():
            want[n, r.k] = (r.score, r.matches)
    assert got == want and len(want) > 100
    best = {(r.query_id, r["rank"]): r.key for r in index.search(queries, weights, k=3).collect()}
    for n in range(len(asked)):
        order = sorted((k for q, k in want if q == n), key=lambda k: (-want[n, k][0], k))[:3]
        assert [best.get((n, p + 1)) for p in range(len(order))] == order
    assert index.search(queries.where("false"), weights).count() == 0
    empty = SearchIndex.build(df.where("false"), "k", tuple(weights))
    assert empty.search(queries, weights).count() == 0 and empty.search(queries, weights, k=2).select(F.col("rank")).count() == 0


def test_equal_queries_are_searched_once(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"red bolt {k}", "steel") for k in range(40)] + [(40, "blue", "tin")], "k long, name string, kind string")
    weights = {"name": 3, "kind": 1}
    index = SearchIndex.build(df, "k", tuple(weights))
    kept = {}
    monkeypatch.setattr("loomgraph.operators.index.cut", lambda df, name="cut": kept.setdefault(name, df.localCheckpoint()))
    queries = spark.createDataFrame([(q, "red bolt") for q in range(50)] + [(50, "Blue"), (51, "blue"), (52, None), (53, "RedBolt")], "query_id long, query string")
    best = index.search(queries, weights, k=2).collect()
    assert kept["asked"].count() == 3
    assert sorted((r.query_id, r.key) for r in best if r.query_id < 50) == [(q, k) for q in range(50) for k in (0, 1)]
    whole = {(r.query_id, r.key): r.score for r in index.search(queries, weights).collect()}
    assert len(whole) == 51 * 40 + 2 and len({v for (q, _), v in whole.items() if q < 50}) == 1
    assert whole[50, 40] == whole[51, 40] > 0


def test_hits_of_all_askers_go_to_tasks_by_their_rows(spark):
    """Few bytes are dealt, so Spark would make all rows in one task."""
    df = spark.range(300).selectExpr("id as k", "'red bolt' as name")
    asked = spark.range(4500).selectExpr("id as query_id", "'bolt' as query").union(spark.sql("select cast(null as bigint), 'bolt'"))
    got = SearchIndex.build(df, "k", ("name",)).search(asked, {"name": 1})
    found = got.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.countDistinct("query_id", "key").alias("pairs"), F.count_if(F.isnull("query_id")).alias("nobody"), F.countDistinct("score").alias("scores")).first()
    assert (found.n, found.pairs, found.nobody, found.scores) == (300 * 4501, 300 * 4500, 300, 1)
    assert found.tasks > 1
