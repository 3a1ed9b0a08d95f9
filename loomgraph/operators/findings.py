"""Rules, impact, clusters, plans and resolution hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_file
from .components import connected_components
from .graph import blast_radius
from .ordering import greedy_fill
from .score import simulate

SEVERITY_SCORE = {"high": 0.9, "medium": 0.6, "low": 0.3, "info": 0.1}
TEST_WEIGHT = 0.15
#: fixed values: superseded packages, what replaces them, and why they count
LEGACY_PACKAGES = (
    ("request", "undici / native fetch", "deprecated"),
    ("moment", "dayjs / date-fns / Temporal", "maintenance-mode"),
    ("node-sass", "sass (dart-sass)", "deprecated"),
    ("babel-eslint", "@babel/eslint-parser", "superseded"),
    ("tslint", "eslint + typescript-eslint", "deprecated"),
    ("left-pad", "String.prototype.padStart", "native-replacement"),
    ("mkdirp", "fs.mkdir({recursive:true})", "native-replacement"),
    ("rimraf", "fs.rm({recursive:true,force:true})", "native-replacement"),
    ("body-parser", "express.json()/express.urlencoded()", "bundled"),
    ("bluebird", "native Promise", "native-replacement"),
    ("underscore", "native array/object methods or lodash-es", "superseded"),
    ("q", "native Promise", "native-replacement"),
)


def legacy_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependencies that the table names: (package, replacement, kind)."""
    known = dependencies.sparkSession.createDataFrame(list(LEGACY_PACKAGES), "package string, replacement string, kind string")
    return dependencies.join(F.broadcast(known), "package").select("package", "replacement", "kind")


def priority_of(severity, priority) -> F.Column:
    """A finding's own priority, else its severity's."""
    by = F.lit(0.0)
    for name, score in SEVERITY_SCORE.items():
        by = F.when(severity == name, score).otherwise(by)
    return F.coalesce(priority, by)


def pattern_rules(texts: DataFrame, rules: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """(rule, occurrences, n_files, files): one pass for all rules; files are
    aggregated as counts and the first by name."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long").alias("n")) for name, pattern in sorted(rules.items())])
    hits = texts.select(key, F.explode(counts).alias("r")).select(key, "r.rule", "r.n").where("n > 0")
    return hits.groupBy("rule").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_files"), F.min(key).alias("first_file"))


def duplicate_groups(functions: DataFrame) -> DataFrame:
    """(shape_hash, n, files) of function shapes that occur more than once."""
    return functions.where("shape_hash is not null").groupBy("shape_hash").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file")).alias("files")).where("n > 1")


def impact(findings: DataFrame, repo_files: int) -> DataFrame:
    """reach, safety, impact and priority of findings.

    findings: id, files array<struct<file,tested>>, occurrences, certainty. Test
    files weigh TEST_WEIGHT; no files is safety 1.
    """
    files = F.col("files")
    n = F.size(files)
    weighted = F.aggregate(files, F.lit(0.0), lambda a, f: a + F.when(is_test_file(f["file"]), TEST_WEIGHT).otherwise(1.0))
    average = F.when(n > 0, weighted / n).otherwise(1.0)
    size = float(max(1, repo_files))
    reach = F.least(F.lit(1.0), weighted / size + F.col("occurrences") * average / (size * 5))
    safety = F.when(n > 0, F.size(F.filter(files, lambda f: f["tested"])) / n).otherwise(1.0)
    made = findings.withColumns({"reach": reach, "safety": safety}).withColumn("impact", F.col("reach") * F.col("certainty"))
    return made.select("id", *[F.round(c, 3).alias(a) for c, a in (("reach", "reach"), ("safety", "safety"), ("impact", "impact"))], F.round(F.col("impact") * (0.5 + 0.5 * F.col("safety")), 3).alias("priority"))


#: fixed values: calls that the runtime has deprecated
DEPRECATED_CALLS = ("url.parse", "fs.exists", "util.isArray", "querystring.parse")


def code_patterns(nodes: DataFrame, scope: DataFrame | None = None, generated: DataFrame | None = None, package_type: str | None = None) -> DataFrame:
    """(rule, occurrences, n_files, first_file) of patterns worth modernising.

    nodes: file, var_count, module_type, functions (with calls). Files out of
    scope and generated ones don't count. Module ambiguity is a finding only in
    a package of type module, and never for .cjs, which is explicit.
    """
    if scope is not None:
        nodes = nodes.join(scope.select("file").distinct(), "file", "left_semi")
    if generated is not None:
        nodes = nodes.join(generated.select("file").distinct(), "file", "left_anti")
    calls = F.flatten(F.transform("functions", lambda f: f["calls"]))
    ambiguous = (F.lit(package_type) == "module") & (F.col("module_type") == "script") & ~F.col("file").endswith(".cjs")
    counts = {
        "var-declarations": F.col("var_count"),
        "promise-then-chains": F.size(F.filter(calls, lambda c: c.endswith(".then") | c.endswith(".catch"))),
        "deprecated-node-api": F.size(F.filter(calls, lambda c: c.isin(*DEPRECATED_CALLS))),
        "cjs-in-esm-project": F.coalesce(ambiguous, F.lit(False)).cast("int"),
    }
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for rule, n in counts.items()])
    hits = nodes.select("file", F.explode(rows).alias("r")).select("file", "r.rule", "r.n").where("n > 0")
    return hits.groupBy("rule").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_files"), F.min("file").alias("first_file"))


def scan_scope(mode: str, workflow_files: DataFrame, orphans: DataFrame) -> DataFrame:
    """Files whose code a scan looks at: none if light, those of the three
    largest workflows if medium, all workflows' and orphans if heavy."""
    if mode == "light":
        return workflow_files.select("file").limit(0)
    if mode == "heavy":
        return workflow_files.select("file").union(orphans.select("file")).distinct()
    sizes = workflow_files.groupBy("workflow").agg(F.countDistinct("file").alias("n"))
    largest = sizes.orderBy(F.col("n").desc(), "workflow").limit(3)
    return workflow_files.join(largest.select("workflow"), "workflow", "left_semi").select("file").distinct()


def modernization_scan(mode: str, dependencies: DataFrame, nodes: DataFrame, workflow_files: DataFrame, orphans: DataFrame, generated: DataFrame, package_type: str | None = None, architecture: DataFrame | None = None) -> DataFrame:
    """(tier, rule, occurrences): dependencies in every mode, code patterns from
    medium on, architecture findings (rule) in a heavy scan."""
    found = legacy_dependencies(dependencies).groupBy(F.concat(F.lit("legacy-"), "kind").alias("rule")).agg(F.count("*").alias("occurrences")).select(F.lit("dependency").alias("tier"), "rule", "occurrences")
    if mode in ("medium", "heavy"):
        patterns = code_patterns(nodes, scan_scope(mode, workflow_files, orphans), generated, package_type)
        found = found.unionByName(patterns.select(F.lit("pattern").alias("tier"), "rule", "occurrences"))
    if mode == "heavy" and architecture is not None:
        found = found.unionByName(architecture.groupBy("rule").agg(F.count("*").alias("occurrences")).select(F.lit("architecture").alias("tier"), "rule", "occurrences"))
    return found


def duplicate_rule(functions: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """duplicate-functions findings (rule, subject, certainty): functions of one
    shape, generated files left out."""
    if generated is not None:
        functions = functions.join(generated.select("file").distinct(), "file", "left_anti")
    groups = duplicate_groups(functions)
    return groups.select(F.lit("duplicate-functions").alias("rule"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("functions in"), F.array_join("files", ", ")).alias("subject"), F.lit(1.0).alias("certainty"))


def architecture_rules(workflows: DataFrame, orphans: DataFrame, files: int, rate: float, cycles: DataFrame) -> DataFrame:
    """monolith, orphan-cluster, fragile and cycle findings.

    workflows: workflow, n_files, score; orphans: file; cycles: cycle, members.
    """
    certainty = 1.0 if rate >= 0.9 else round(0.5 + 0.5 * rate, 2)
    big = workflows.where((F.lit(files) >= 12) & (F.col("n_files") > 0.7 * files)).select(F.lit("monolith").alias("rule"), F.col("workflow").alias("subject"), F.lit(1.0).alias("certainty"))
    lone = orphans.agg(F.count("*").alias("n")).where("n >= 3").select(F.lit("orphan-cluster"), F.concat(F.col("n").cast("string"), F.lit(" files")), F.lit(certainty))
    weak = workflows.where("score < 0.4").select(F.lit("fragile"), F.col("workflow"), F.lit(1.0))
    round_trip = cycles.select(F.lit("cycle"), F.array_join("members", " -> "), F.lit(1.0))
    return big.union(lone).union(weak).union(round_trip)


def solutions(findings: DataFrame, workflow_files: DataFrame, edges: DataFrame, total_files: DataFrame) -> DataFrame:
    """Clusters of findings that share files, by priority.

    findings: id, tier, priority, files array<string>, stale. Stale ones are left
    out; dependency and architecture findings stand alone.
    """
    live = findings.where("not stale")
    alone = F.col("tier").isin("dependency", "architecture")
    touched = live.where(~alone).select("id", F.explode("files").alias("file"))
    hub = touched.groupBy("file").agg(F.min("id").alias("hub"))
    linked = connected_components(touched.join(hub, "file").select("id", "hub"), "id", "hub")
    member = live.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    files = member.select("cluster", F.explode("files").alias("file")).distinct()
    blast = blast_radius(files, workflow_files, edges, total_files)
    return member.groupBy("cluster").agg(F.max("priority").alias("top"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), "+").alias("members")).join(blast, "cluster", "left").select(
        "cluster", "members", "n", F.coalesce("score", F.lit(0.0)).alias("blast"), F.round(F.col("top") * (0.5 + 0.5 * F.coalesce("score", F.lit(0.0))), 3).alias("priority"),
    )


def top_solutions(clusters: DataFrame, k: int = 10) -> DataFrame:
    """The first k clusters of :func:`solutions` by priority."""
    return clusters.orderBy(F.col("priority").desc(), "cluster").limit(k)


def hotspots(calls: DataFrame, workflow_files: DataFrame) -> DataFrame:
    """Files by unresolved and dynamic calls, times the workflows they are in.

    calls: file, resolution, receiver.
    """
    bad = F.col("resolution").isin("unresolved", "dynamic")
    by_file = calls.where(bad).groupBy("file").agg(
        F.count_if(F.col("resolution") == "unresolved").alias("unresolved"), F.count_if(F.col("resolution") == "dynamic").alias("dynamic"),
        F.slice(F.array_sort(F.collect_set("receiver")), 1, 6).alias("receivers"),
    )
    used = workflow_files.groupBy("file").agg(F.countDistinct("workflow").alias("workflows"))
    n = F.coalesce("workflows", F.lit(0))
    return by_file.join(used.hint("merge"), "file", "left").select("file", "unresolved", "dynamic", "receivers", n.alias("workflows"), ((F.col("unresolved") + F.col("dynamic")) * F.greatest(F.lit(1), n)).alias("score"))


def fix_target(items: DataFrame) -> DataFrame:
    """The item to fix first."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    return items.withColumn("_rank", rank * 1000 + F.coalesce("priority", F.lit(0.0))).orderBy(F.col("_rank").desc(), "source", "id").limit(1).drop("_rank")


def handoff(findings: DataFrame, k: int = 5) -> DataFrame:
    """Fresh findings, most important first."""
    return findings.where("not stale and status = 'awaiting-approval'").orderBy(F.col("priority").desc(), "id").limit(k)


def plan_candidates(signals: DataFrame, sizes: DataFrame) -> DataFrame:
    """(workflow, signal, lift): what the repo score gains if one available
    signal reached 1. All candidates in one plan, instead of a run for each."""
    w = Window.partitionBy("workflow")
    weight = F.sum(F.when(F.col("value").isNotNull(), F.col("weight"))).over(w)
    gain = F.when(F.col("value").isNotNull() & (F.col("value") < 1), (1 - F.col("value")) * F.col("weight") / weight)
    total = sizes.agg(F.sum("n_files").alias("total"))  # one row
    shared = sizes.crossJoin(F.broadcast(total)).withColumn("share", F.col("n_files") / F.col("total"))
    return signals.withColumn("gain", gain).join(shared, "workflow").where("gain > 0").select("workflow", "signal", (F.col("gain") * F.col("share") * 0.9).alias("lift"))


#: risks in order
RISKS = ("low", "medium", "high")


def plan_improvements(tasks: DataFrame, signals: DataFrame, budget: float, risk: str = "low") -> tuple[DataFrame, DataFrame]:
    """(tasks taken, scores before and after them together).

    tasks: id, kind, workflow, signal, new_value, effort, risk, lift. Tasks of
    more risk or without lift fall out; the rest are taken by lift per effort
    while they fit. What they reach together is simulated once: a signal that
    several tasks raise takes the largest of their values.
    """
    allowed = RISKS[: RISKS.index(risk) + 1]
    eligible = tasks.where(F.col("risk").isin(*allowed) & (F.col("lift") > 0)).withColumn("plan", F.lit(0))
    taken = greedy_fill(eligible, budget, ["plan"]).select("id")
    chosen = tasks.join(taken, "id", "left_semi")
    overrides = chosen.groupBy("workflow", "signal").agg(F.max("new_value").alias("new_value"))
    return chosen, simulate(signals, overrides)
