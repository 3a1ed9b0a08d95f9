"""Documents, globs and step figures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.paths import glob_regex
from loomgraph.operators import globs
from loomgraph.operators.steps import StepLog, slowest
from loomgraph.plans import documents
from loomgraph.plans.project import analyze
from loomgraph.sources.changes import ChangeStore

from .sample_files import sample_rows


def pieces(rng):
    return rng.choice(["a", "b", "ab", "src", "*", "**", "?", "a*", "*.js", "a**b", "x?", ".", "a.js", "a+b", "(", "é"])


@pytest.mark.parametrize("seed,block", [(1, globs.BLOCK), (2, 40)])
def test_globs_equal_their_expressions(spark, seed, block):
    rng = random.Random(seed)
    wanted = sorted({"/".join(pieces(rng) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/**", "/"]) for _ in range(250)} | {"", "**", "**/", "/**", "a/**/**", "**/**/a"})
    paths = sorted({"/".join(rng.choice(["a", "b", "ab", "src", "aab", "xb", "a.js", "a+b", "(", "é", "", "b.js"]) for _ in range(rng.randrange(1, 6))) for _ in range(200)})
    files = spark.createDataFrame([(p,) for p in paths] + [(None,)], "file string").repartition(3)
    table = spark.createDataFrame(list(enumerate(wanted)) + [(999, None)], "glob_id long, glob string")
    got = {tuple(r) for r in globs.match_globs(files, table, block).collect()}
    assert got == {(p, k) for k, g in enumerate(wanted) for p in paths if re.fullmatch(glob_regex(g)[1:-1], p, re.S)}
    assert globs.match_globs(files, table.where("false")).count() == 0


def test_steps_have_figures(spark):
    log = StepLog(spark)
    p = analyze(sample_rows(spark), steps=log)
    rows = {r.step: r for r in log.table().collect()}
    assert list(rows) == ["files", "nodes", "imports", "calls", "entries", "workflows", "credit"]
    assert rows["files"].rows == p.files.count() and rows["calls"].rows == p.call_edges.count() and rows["credit"].rows == p.test_credit.count()
    assert all(r.bytes > 0 and r.files > 0 and r.seconds > 0 for r in rows.values())
    top = slowest(log.table(), 3).collect()
    assert len(top) == 3 and top[0].seconds >= top[2].seconds and 0 < top[0].share < 1


@pytest.fixture(scope="module")
def relations(spark):
    files = [("wf:<a> \"x\"", f"src/{k}.js") for k in range(5)] + [("wf:big", f"f{k:04}") for k in range(2500)]
    workflow_files = spark.createDataFrame(files + [("wf:one", "o[1]\"x\".js")], "workflow string, file string").repartition(4)
    workflows = spark.createDataFrame([("wf:<a> \"x\"", 5, 7, 0.5, 0.9), ("wf:big", 2500, 0, 1.0, 1.0), ("wf:one", 1, 0, None, None)], "workflow string, n_files long, n_functions long, score double, signal_coverage double")
    signals = spark.createDataFrame([("wf:<a> \"x\"", "tests", None, 0.25), ("wf:<a> \"x\"", "parse", 0.5, 0.3), ("wf:big", "parse", 1.0, 0.3)], "workflow string, signal string, value double, weight double")
    edges = spark.createDataFrame([("src/0.js", "src/1.js"), ("src/0.js", "src/1.js"), ("src/1.js", "other"), ("f0001", "f0002")], "src string, dst string")
    return workflows, signals, workflow_files, edges


def test_pages(relations):
    pages = {r.file: r.text for r in documents.workflow_pages(*relations).collect()}
    assert len(pages) == 9 + 1 + 1 + 3 and all(re.fullmatch(r"workflows/[A-Za-z0-9-]+(/files-\d+)?\.(md|html|json)", f) for f in pages)
    one = next(t for f, t in pages.items() if f.startswith("workflows/wf-a-x") and f.endswith(".md") and "files-" not in f)
    assert one.count(" --> ") == 1 and one.count('.js"]') == 5 and "| tests | unavailable | 0.25 |" in one and one.index("| parse") < one.index("| tests")
    page = next(t for f, t in pages.items() if f.startswith("workflows/wf-a-x") and f.endswith(".html"))
    assert "wf:&lt;a&gt; &quot;x&quot;" in page and "<a>" not in page
    big = [t for f, t in pages.items() if f.startswith("workflows/wf-big") and "files-" in f]
    assert len(big) == 3 and sorted(x for t in big for x in re.findall("`(f.*)`", t)) == [f"f{k:04}" for k in range(2500)]
    assert "2500 files, listed below" in next(t for f, t in pages.items() if f.startswith("workflows/wf-big") and f.endswith(".md") and "files-" not in f)
    lone = next(t for f, t in pages.items() if f.startswith("workflows/wf-one") and f.endswith(".md") and "files-" not in f)
    assert "[\"o(1)'x'.js\"]" in lone and "- score: unavailable" in lone


def test_pages_are_written_by_tasks_and_again_alike(spark, relations, tmp_path):
    read = lambda root: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    for name, parts in (("a", 2), ("b", 7)):
        (tmp_path / name).mkdir()
        workflows, signals, workflow_files, edges = (df.repartition(parts, F.rand(parts)) for df in relations)
        ChangeStore(spark, str(tmp_path / name), str(tmp_path / f"store-{name}")).apply(documents.workflow_pages(workflows, signals, workflow_files, edges), "docs")
    assert read(tmp_path / "a") == read(tmp_path / "b") and len(read(tmp_path / "a")) == 14
