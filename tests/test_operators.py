import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths, text
from loomgraph.operators import diff, findings, graph, ordering, search
from loomgraph.sources.project import filtered, read_jsonc, script_references
from loomgraph.streaming import remap


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("edges,want", [
    ([("a", "b"), ("b", "c"), ("c", "a")], [["a", "b", "c"]]),
    ([("e", "a"), ("e", "x"), ("e", "s"), ("a", "b"), ("b", "a"), ("x", "y"), ("y", "x")], [["a", "b"], ["x", "y"]]),
    ([("a", "a")], [["a"]]),
    ([("a", "b")], []),
])
def test_cycles(spark, edges, want):
    got = graph.cycles(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(r.members for r in got.collect()) == want


def test_reach_with_island(spark):
    edges = spark.createDataFrame([("entry", "mid"), ("mid", "leaf"), ("island", "leaf")], "src string, dst string")
    got = graph.reach(edges, spark.createDataFrame([("entry",)], "start string"))
    assert rows(got, "node", "depth") == [("entry", 0), ("leaf", 2), ("mid", 1)]


def test_lifecycle(spark):
    old = [("open", "awaiting-approval"), ("open-gone", "awaiting-approval"), ("no", "dismissed"), ("no-gone", "dismissed"), ("done", "resolved"), ("done-gone", "resolved"), ("ok-gone", "approved"), ("odd-gone", "odd")]
    prev = spark.createDataFrame([(k, s, 1) for k, s in old] + [("open", "approved", 0)], "k string, status string, ord int")
    new = spark.createDataFrame([("open",), ("no",), ("done",), ("fresh",)], "k string")
    assert dict(rows(diff.lifecycle(new, prev, ["k"]))) == {
        "open": "awaiting-approval", "fresh": "awaiting-approval", "no": "dismissed", "done": "resolved",
        "open-gone": "resolved", "ok-gone": "resolved", "no-gone": "dismissed", "done-gone": "resolved",
    }
    with pytest.raises(ValueError):
        diff.check_schema(3)


def test_pack(spark):
    items = spark.createDataFrame([(1, 0, "a" * 50, 10.0), (1, 1, "b" * 50, 5.0), (1, 2, "c" * 50, 1.0), (1, 3, "a" * 50, 7.0)], "k int, ord int, text string, priority double")
    assert [len(r.packed) for r in ordering.pack(items, 70, ["k"]).orderBy("ord").collect()] == [50, 20]


def test_greedy_fill_skips(spark):
    tasks = spark.createDataFrame([(1, "a", 5.0, 50.0), (1, "b", 8.0, 40.0), (1, "c", 3.0, 6.0)], "k int, id string, effort double, lift double")
    assert rows(ordering.greedy_fill(tasks, 9.0, ["k"]), "id") == [("a",), ("c",)]


def test_redaction(spark):
    secrets = ["sk-abcdefghijklmnopqrst", "AKIA" + "A" * 16, "Authorization: Bearer abcdefghijklmnop", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "API_KEY=abcdef123456", "const x = 1;"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(secrets)], "i int, t string").orderBy("i").select(text.redact(F.col("t"))).collect()]
    assert all("REDACTED" in x for x in got[:5]) and got[5] == secrets[5]


def test_globs_and_paths(spark):
    import re

    assert re.match(paths.glob_regex("a/*.js"), "a/b.js") and not re.match(paths.glob_regex("a/*.js"), "a/b/c.js")
    assert re.match(paths.glob_regex("dir/**"), "dir") and re.match(paths.glob_regex("**/x.js"), "x.js") and re.match(paths.glob_regex("a?.js"), "ab.js")
    assert re.match(paths.annotation_regex("ab?.js"), "a.js") and paths.static_prefix("src/**/x") == "src"
    df = spark.createDataFrame([("a/./b/../c//d.test.js",), ("../x",), ("contests/x.js",), ("x.bundle.js",)], "p string")
    got = df.select(paths.normalize(F.col("p")), paths.is_test_file(F.col("p")), paths.has_test_path(F.col("p")), paths.generated_name(F.col("p"))).collect()
    assert [r[0] for r in got] == ["a/c/d.test.js", "../x", "contests/x.js", "x.bundle.js"]
    assert [r[1] for r in got] == [True, False, False, False] and got[2][2] and got[3][3]


def test_scan_filters_and_scripts(spark):
    df = spark.createDataFrame([("src/a.js", ""), (".git/x", ""), (".env.example", ""), ("node_modules/q.js", ""), ("web/i.html", '<p>\n<script src="./a.js?v=1"></script><script src="/abs.js"></script><script src="https://x/y.js"></script>')], "file string, text string")
    assert rows(filtered(df, exclude=("web/**",)), "file") == [(".env.example",), ("src/a.js",)]
    assert rows(script_references(df)) == [("web/i.html", "./a.js", 2)]
    assert read_jsonc('{"u": "http://x", /* c */ "l": [1,],}') == {"u": "http://x", "l": [1]} and read_jsonc("{") == {}


def test_search_ranks_names_first(spark):
    df = spark.createDataFrame([("src/auth/session.js", "loginUser", "a b"), ("src/bill.js", "invoice", "session")], "file string, function string, calls string")
    got = search.search(df, "login session", {"function": 7, "file": 5, "calls": 3}).orderBy(F.col("score").desc()).collect()
    assert got[0].function == "loginUser" and got[0].matches == ["function", "file"]


def test_test_files_weigh_less(spark):
    f = lambda p, t: {"file": p, "tested": t}
    df = spark.createDataFrame([("t", [f(f"tests/{k}.js", True) for k in range(11)], 11, 1.0), ("p", [f("src/a.js", True), f("src/b.js", False)], 2, 1.0)], "id string, files array<struct<file:string,tested:boolean>>, occurrences int, certainty double")
    got = {r.id: r for r in findings.impact(df, 100).collect()}
    assert got["p"].reach == 0.024 and got["p"].safety == 0.5 and got["t"].reach <= 0.02 and got["t"].priority > 0


def test_solutions_cluster_by_shared_files(spark):
    items = spark.createDataFrame([("a", "pattern", 0.5, ["x"], False), ("b", "pattern", 0.7, ["x", "y"], False), ("c", "pattern", 0.2, ["z"], False), ("d", "architecture", 0.9, ["x"], False), ("e", "pattern", 1.0, ["x"], True)], "id string, tier string, priority double, files array<string>, stale boolean")
    wf = spark.createDataFrame([("w", "x")], "workflow string, file string")
    edges = spark.createDataFrame([("q", "x")], "src string, dst string")
    got = findings.solutions(items, wf, edges, spark.createDataFrame([("x",), ("y",), ("z",), ("q",)], "file string"))
    assert rows(got, "members", "n") == [("a+b", 2), ("c", 1), ("d", 1)]


def test_stream_keeps_going_and_equals_batch(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    seen, errors = [], []

    def on_change(df, n):
        seen.append(rows(df))
        if n == 1:
            raise RuntimeError("bad batch")

    parts = [[("a", "1", day), ("b", "2", day)], [("a", "3", day + datetime.timedelta(hours=1))], [("b", None, day + datetime.timedelta(hours=2))]]
    for part in parts:
        spark.createDataFrame(part, remap.STATE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(remap.STATE).parquet(src)
        q = remap.watch(stream, str(tmp_path / "state"), str(tmp_path / "cp"), on_change, lambda e, n: errors.append(n)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == [[("a", "added"), ("b", "added")], [("a", "changed")], [("b", "removed")]] and errors == [1]
    whole = remap.merge(spark.createDataFrame([], remap.STATE), spark.createDataFrame(sum(parts, []), remap.STATE))
    assert rows(whole, "file", "text") == rows(spark.read.parquet(str(tmp_path / "state/v2")), "file", "text") == [("a", "3")]
