import pytest
from pyspark.sql import functions as F

from loomgraph.operators import detectors, requests

FILES = {
    "src/load.js": "const m = await import(`./plugins/${name}.js`); new Worker(new URL('./work.js', import.meta.url)); import.meta.glob('./views/**/*.vue.js')",
    "src/plugins/a.js": "", "src/work.js": "", "src/views/x/y.vue.js": "", "src/views/z.vue.js": "", "src/other.js": "",
    "jest.config.js": "module.exports = { testMatch: ['specs/**/*.js'], roots: [\"more\"] }", "specs/a.js": "",
    "vite.config.ts": "export default { build: { rollupOptions: { input: { main: 'src/work.js' } }, lib: { entry: './src/other' } } }",
    "desk/main.js": "new BrowserWindow({ webPreferences: { preload: path.join(__dirname, 'pre.js') } })", "desk/pre.js": "",
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, v) for k, v in FILES.items()], "file string, text string")


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_dynamic_reach(rows):
    assert pairs(detectors.template_folders(rows), "folder") == {("src/plugins",)}
    assert pairs(detectors.worker_files(rows, rows), "file") == {("src/work.js",)}
    assert pairs(detectors.glob_imports(rows, rows), "file") == {("src/views/x/y.vue.js",), ("src/views/z.vue.js",)}
    assert pairs(detectors.runner_folders(rows), "folder") == {("specs",), ("more",)}


def test_tool_entries(rows):
    assert pairs(detectors.bundle_entries(rows, rows), "file") == {("src/work.js",), ("src/other.js",)}
    assert pairs(detectors.preload_entries(rows, rows), "file") == {("desk/pre.js",)}


def test_scripts_and_stack(spark):
    df = spark.createDataFrame([("dev", "x"), ("test:dev", "node a"), ("go", "node a.js"), ("build", "vite build"), ("tidy", "rm")], "n string, c string")
    assert [r[0] for r in df.select(detectors.is_runtime_script(F.col("n"), F.col("c"))).collect()] == [True, False, True, False, False]
    assert detectors.stack({"next", "react", "express"}, True) == {"languages": ["TypeScript", "JavaScript"], "frameworks": ["Next.js", "Express"]}


ASKED = {
    "Run a project map.": "map", "Create a baseline": "baseline", "Check this project against the baseline": "check", "Run the modernization scan": "modernize",
    "Diagnose the understanding limits": "diagnose", "what's the honest ceiling": "ceiling", "how high can the score go": "ceiling", "explain the confidence score": "explain",
    "Why did confidence change?": "score-delta", "what should I work on next": "improve", "show me the test gaps": "test-gaps", "which tests are padding": "padding",
    "which tests cover src/a.js": "test-credit", "is the project passing": "verify", "Run the tests": "test", "Run the linter": "lint", "build the project": "build", "install dependencies": "install",
    "start the dev server": "serve", "show the git diff": "diff", "start watching the project": "watch", "show the review queue": "review", "list findings": "findings",
    "save the chat": "transcript", "show unresolved calls": "resolution", "trace a.js to b.js": "trace", "search for all references to total": "references", "show me the status": "status",
    "where is the login code": "find", "hand off the top findings": "handoff", "give me the top solutions": "solutions", "generate the docs": "docs", "could you please approve finding ab12": "approve",
    "/modernize heavy": "modernize", "/nope": "unknown", "hello there": "unknown", "": "unknown",
}


def test_requests(spark):
    df = spark.createDataFrame([(k,) for k in ASKED], "t string")
    got = {r.t: r.op for r in df.select("t", requests.operation(F.col("t")).alias("op")).collect()}
    assert got == ASKED
    assert spark.createDataFrame([(None,)], "t string").select(requests.operation(F.col("t"))).first()[0] == "unknown"


def test_what_requests_are_about(spark):
    said = ["Dismiss finding def67890 because it is intentional", "Fix finding abc12345", "Fix the highest-severity finding", "what is the import chain from src/a.js to b/c.ts?", "find code related to login session", "/improve --budget 2h --risk low"]
    rows = [r.request for r in requests.request_of(spark.createDataFrame([(t,) for t in said], "text string")).collect()]
    assert (rows[0].operation, rows[0].finding, rows[0].reason) == ("dismiss", "def67890", "it is intentional")
    assert (rows[1].operation, rows[1].finding) == ("fix", "abc12345") and (rows[2].operation, rows[2].finding) == ("fix", None)
    assert (rows[3].operation, rows[3].files) == ("trace", ["src/a.js", "b/c.ts"]) and (rows[4].operation, rows[4].query) == ("find", "login session")
    assert (rows[5].operation, rows[5].arguments) == ("improve", ["--budget", "2h", "--risk", "low"])
