import pytest

from loomgraph.operators import graph, score
from loomgraph.operators.resolve import call_stats
from loomgraph.plans.project import analyze

FILES = {
    "package.json": '{"name": "demo", "bin": {"demo": "dist/main.js"}, "imports": {"#lib/*": "./src/lib/*.js"}}',
    "tsconfig.json": '{"compilerOptions": {"outDir": "dist", "rootDir": "src", "baseUrl": ".", "paths": {"@/*": ["src/*"],}}} // end',
    "src/main.ts": 'import { util } from "./util.js";\nimport fs from "fs";\nimport { deep } from "@/lib/deep";\nimport { missing } from "./nowhere";\nexport function main() {\n  util();\n  fs.readFileSync("x");\n  console.log(1);\n  mystery();\n  missing();\n  deep();\n  other.thing();\n}\n',
    "src/util.ts": "export function util() { return 1 }\n",
    "src/lib/deep.js": 'import { util } from "../util";\nexport const deep = () => util();\n',
    "src/island.js": "export const alone = 1;\n",
    "src/app.min.js": "var a=1",
    "tests/util.test.js": 'import { util } from "../src/util";\ntest(util());\n',
    "tests/island.test.js": "test(1);\n",
    "tool/run.py": 'from . import helper\nif __name__ == "__main__":\n    pass\n',
    "tool/helper.py": "def f():\n    pass\n",
    "tool/__init__.py": "",
    "store/store.go": "package store\nfunc Open() {}\nfunc close() {}\n",
    "main.go": 'package main\nimport "example.com/app/store"\nfunc main() { store.Open() }\n',
    "rs/main.rs": "mod store;\nfn main() {}\n",
    "rs/store.rs": "pub fn open() {}\nfn internal() {}\n",
}


@pytest.fixture(scope="module")
def project(spark):
    rows = spark.createDataFrame([(k, v, len(v)) for k, v in FILES.items()], "file string, text string, size long")
    return analyze(rows)


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_import_edges(project):
    edges = {x for x in pairs(project.import_edges, "file", "to_file") if x[1]}
    assert edges == {
        ("src/main.ts", "src/util.ts"), ("src/main.ts", "src/lib/deep.js"), ("src/lib/deep.js", "src/util.ts"), ("tests/util.test.js", "src/util.ts"),
        ("tool/run.py", "tool/__init__.py"), ("main.go", "store/store.go"), ("rs/main.rs", "rs/store.rs"),
    }
    assert ("src/main.ts", "fs") in pairs(project.import_edges, "file", "external")
    assert ("src/main.ts", "./nowhere") in pairs(project.import_edges, "file", "unresolved")


def test_call_resolution(project):
    got = dict(pairs(project.call_edges.where("file = 'src/main.ts'"), "call", "resolution"))
    assert got == {"util": "cross-file", "fs.readFileSync": "external", "console.log": "global", "mystery": "unresolved", "missing": "external", "deep": "cross-file", "other.thing": "dynamic"}
    stats = call_stats(project.call_edges.where("file = 'src/main.ts'")).first()
    assert (stats.resolved, stats.total) == (5, 6)


def test_entries_and_buckets(project):
    kinds = dict(pairs(project.entry_points, "file", "kind"))
    assert kinds == {"src/main.ts": "bin", "tool/run.py": "python-main-guard", "main.go": "go-main", "rs/main.rs": "rust-main"}
    buckets = dict(pairs(project.reachability, "file", "bucket"))
    assert buckets["src/island.js"] == "orphan" and buckets["src/app.min.js"] == "generated"
    assert buckets["tool/helper.py"] == "heuristic-unverified" and buckets["tests/util.test.js"] == "test"
    assert buckets["src/util.ts"] == buckets["rs/store.rs"] == "reachable"


def test_credit_and_scores(project):
    credit = dict(pairs(project.test_credit, "file", "status"))
    assert credit["src/util.ts"] == "tested-real" and credit["src/island.js"] == "tested-nameonly" and credit["src/main.ts"] == "untested"
    values = {(r.workflow, r.signal): r.value for r in project.signals.collect()}
    wf = "wf:bin:src/main.ts"
    assert values[wf, "parseIntegrity"] == 0.5 and values[wf, "stability"] is None
    total = score.explain(project.signals).groupBy("workflow").sum("contribution").collect()
    want = {r.workflow: r.score for r in score.workflow_scores(project.signals).collect()}
    assert all(abs(r[1] - want[r.workflow]) < 1e-12 for r in total)


def test_chain(project):
    edges = project.import_edges.where("to_file is not null").selectExpr("file as src", "to_file as dst", "'import' as via")
    got = [(r.src, r.dst) for r in graph.shortest_path(edges, "src/main.ts", "src/util.ts").orderBy("step").collect()]
    assert got == [("src/main.ts", "src/util.ts")]
    assert graph.shortest_path(edges, "src/island.js", "src/util.ts").count() == 0
