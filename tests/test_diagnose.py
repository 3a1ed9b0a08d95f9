"""Impact of fixes, health after them, diagnosis, context."""

import pytest

from loomgraph.operators import diagnose
from loomgraph.plans import reports

from .sample_files import sample, sample_rows

FINDINGS = "id string, kind string, severity string, files array<string>, workflow string"


def test_fix_impact(spark):
    findings = spark.createDataFrame([
        ("a", "export-removed", "low", ["x", "x", "y", "z"], None), ("b", "orphan", "medium", ["z"], None), ("c", "parse-failure", "high", None, "w9"), ("d", "orphan", None, [], None), ("e", None, "high", ["x", None], "w1"),
    ], FINDINGS)
    homes = spark.createDataFrame([("x", "w1"), ("x", "w2"), ("y", "w2"), ("q", "w3")], "file string, workflow string")
    credit = spark.createDataFrame([("x", "tested-real"), ("x", "tested-real"), ("y", "tested-nameonly")], "file string, status string")
    got = {r.id: (r.risk, r.n_files, r.in_workflow, r.tested, r.untested, r.workflows, r.blast_radius) for r in diagnose.fix_impact(findings, homes, credit).collect()}
    assert got == {
        "a": ("high", 3, 2, 1, 1, ["w1", "w2"], 2), "b": ("medium", 1, 0, 0, 0, [], 0), "c": ("medium", 0, 0, 0, 0, ["w9"], 1),
        "d": ("low", 0, 0, 0, 0, [], 0), "e": ("high", 1, 1, 1, 0, ["w1", "w2"], 2),
    }


def test_parse_gain(spark):
    signals = spark.createDataFrame([("w", "parseIntegrity", 0.5, 0.3), ("w", "testPresence", 1.0, 0.3), ("v", "parseIntegrity", 1.0, 0.3)], "workflow string, signal string, value double, weight double")
    homes = spark.createDataFrame([("a", "w"), ("b", "w"), ("c", "v")], "file string, workflow string")
    got = diagnose.parse_gain(spark.createDataFrame([("a",), ("c",), ("no",)], "file string"), homes, signals).collect()
    assert [(r.workflow, r.before, r.after) for r in got] == [("w", 0.75, 1.0)]


@pytest.mark.parametrize("after, confidence, want", [
    (["a", "b"], (0.5, 0.5), set()),
    (["a", "c"], (0.5, 0.6), {("workflow-gone", "b")}),
    ([], (0.5, 0.4), {("workflow-gone", "a"), ("workflow-gone", "b"), ("fewer-workflows", "2 -> 0"), ("confidence-dropped", "0.5 -> 0.4")}),
])
def test_health(spark, after, confidence, want):
    frame = lambda names: spark.createDataFrame([(x,) for x in names], "workflow string")
    got = diagnose.post_apply_health(frame(["a", "b"]), frame(after), spark.createDataFrame([confidence], "before double, after double"))
    assert {tuple(r) for r in got.collect()} == want


def test_advice(spark):
    names = ("repo_confidence", "threshold", "call_rate")
    counts = ("low_test_presence", "unresolved_calls", "dynamic_calls", "unresolved_imports", "unmapped_scripts", "env_keys", "unsupported_files", "heuristic_files")
    schema = ", ".join([f"{n} double" for n in names] + [f"{n} long" for n in counts] + ["env_example boolean"])
    ask = lambda *row: [r.advice for r in diagnose.recommendations(spark.createDataFrame([row], schema)).orderBy("ord").collect()]
    assert ask(0.9, 0.8, 1.0, 0, 0, 0, 0, 0, 3, 0, 0, True) == ["nothing"]
    assert ask(None, 0.8, None, None, None, None, None, None, None, None, None, None) == ["nothing"]
    assert ask(0.7, 0.8, 0.8, 1, 0, 0, 2, 1, 3, 1, 1, False) == [name for name, _ in diagnose.ADVICE]


def test_context(spark):
    parts = spark.createDataFrame([(1, "hit", 1, "h" * 4), (1, "summary", 1, "s" * 3), (1, "task", 1, "t" * 3), (1, "junk", 0, "j"), (1, "changes", 1, "s" * 3), (1, "findings", 2, " ")], "q int, kind string, ord int, text string")
    got = diagnose.assemble_context(parts, 8, ["q"]).orderBy("priority", ascending=False).collect()
    assert [(r.kind, r.packed) for r in got] == [("summary", "sss"), ("task", "ttt"), ("hit", "hh")]


def test_diagnosis(spark):
    d = reports.diagnosis(sample(spark), sample_rows(spark))
    assert [(r.name, r.script, r.mapped) for r in d["scripts"].collect()] == [("start", "src/cli.mjs", True)]
    assert ("src/server.ts", "lost") in {(r.file, r.call) for r in d["calls"].collect()}
    facts = d["facts"].first()
    assert facts.env_keys == 3 and facts.unmapped_scripts == 0 and not facts.env_example and facts.heuristic_files > 0
    advice = [r.advice for r in d["advice"].orderBy("ord").collect()]
    assert "document-environment" in advice and "annotate-entry-points" in advice and "point-scripts-at-files" not in advice
