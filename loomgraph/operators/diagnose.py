"""What a fix touches, whether a project is worse after one, what limits a
project's analysis, and the context of a question about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import pack, top
from .score import simulate, weak_signals, workflow_scores

#: fixed values: risks of a fix by the finding's kind, where its severity doesn't say
KIND_RISKS = {"parse-failure": "medium", "export-removed": "high", "workflow-removed": "high", "confidence-regression": "medium", "resolution-degradation": "medium"}
#: fixed values: priorities of the parts of a context
CONTEXT_PRIORITIES = {"summary": 10.0, "task": 9.5, "changes": 9.0, "findings": 8.8, "package": 8.7, "workflows": 8.0, "conversation": 7.0, "hit": 5.0}


def fix_risk(kind: F.Column, severity: F.Column) -> F.Column:
    """Risk of a fix: by the finding's kind, else its severity, else low."""
    by_kind = reduce(lambda out, k: F.when(kind == k, KIND_RISKS[k]).otherwise(out), KIND_RISKS, F.lit(None).cast("string"))
    return F.coalesce(by_kind, F.when(severity.isin("high", "medium"), severity), F.lit("low"))


def fix_impact(findings: DataFrame, workflow_files: DataFrame, credit: DataFrame) -> DataFrame:
    """A row for each finding: its risk, its files, those in workflows, those of
    them with honest tests and without, the workflows it touches and their number.

    findings: id, kind, severity, files, workflow (the one a regression names, or
    null). credit: file, status. Both sides of the joins grow with the project;
    files of a finding count once, and a finding without files stays.
    """
    tested = credit.where(F.col("status").isin("tested-real", "tested-shallow")).select("file", F.lit(True).alias("tested")).distinct()
    touched = findings.select("id", F.explode(F.array_distinct("files")).alias("file")).where("file is not null")
    homes = touched.join(workflow_files.select("file", F.col("workflow").alias("home")), "file").groupBy("id", "file").agg(F.collect_set("home").alias("homes"))
    found = homes.join(tested, "file", "left").groupBy("id").agg(
        F.count("*").alias("inside"), F.count_if("tested").alias("tested"), F.flatten(F.collect_list("homes")).alias("homes"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    named = F.when(F.col("workflow").isNotNull(), F.array("workflow")).otherwise(F.array().cast("array<string>"))
    workflows = F.array_sort(F.array_distinct(F.concat(named, F.coalesce("homes", F.array().cast("array<string>")))))
    return findings.join(found, "id", "left").select(
        "id", "kind", "severity", fix_risk(F.col("kind"), F.col("severity")).alias("risk"),
        F.when(F.col("files").isNull(), 0).otherwise(F.size(F.array_compact(F.array_distinct("files")))).alias("n_files"),
        zero("inside").alias("in_workflow"), zero("tested").alias("tested"), (zero("inside") - zero("tested")).alias("untested"),
        workflows.alias("workflows"), F.size(workflows).alias("blast_radius"),
    )


def parse_gain(broken: DataFrame, workflow_files: DataFrame, signals: DataFrame) -> DataFrame:
    """Scores before and after all ``broken`` files (file) of workflows parse:
    each raises parseIntegrity by its share of the workflow's files."""
    share = workflow_files.join(broken.select("file", F.lit(1.0).alias("fixed")).distinct(), "file", "left").groupBy("workflow").agg((F.sum(F.coalesce("fixed", F.lit(0.0))) / F.count("*")).alias("share"))
    raised = signals.where("signal = 'parseIntegrity' and value is not null").join(share.where("share > 0"), "workflow")
    return simulate(signals, raised.select("workflow", "signal", F.least(F.col("value") + F.col("share"), F.lit(1.0)).alias("new_value")))


def post_apply_health(before: DataFrame, after: DataFrame, confidence: DataFrame) -> DataFrame:
    """(issue, subject): what is worse after a change; empty if nothing is.

    before, after: workflow. confidence: one row of before and after.
    """
    lost = confidence.where("after < before").select(F.lit("confidence-dropped").alias("issue"), F.concat_ws(" -> ", F.col("before").cast("string"), F.col("after").cast("string")).alias("subject"))
    counts = before.agg(F.countDistinct("workflow").alias("b")).crossJoin(after.agg(F.countDistinct("workflow").alias("a")))  # one row each
    fewer = counts.where("a < b").select(F.lit("fewer-workflows").alias("issue"), F.concat_ws(" -> ", F.col("b").cast("string"), F.col("a").cast("string")).alias("subject"))
    gone = before.select("workflow").distinct().join(after, "workflow", "left_anti").select(F.lit("workflow-gone").alias("issue"), F.col("workflow").cast("string").alias("subject"))
    return lost.unionByName(fewer).unionByName(gone)


def weak_workflows(signals: DataFrame, threshold: float, most: int) -> DataFrame:
    """(workflow, score, weak): the lowest of the workflows that score below the
    threshold or have an unavailable or low signal, with the names of these."""
    weak = weak_signals(signals).groupBy("workflow").agg(F.array_sort(F.collect_set("signal")).alias("weak"))
    rows = workflow_scores(signals).join(weak, "workflow", "left").where((F.coalesce("score", F.lit(1.0)) < threshold) | F.col("weak").isNotNull())
    return top(rows.select("workflow", "score", F.coalesce("weak", F.array().cast("array<string>")).alias("weak")), most, F.coalesce("score", F.lit(1.0)), "workflow")


#: advice and the fact that calls for it, in order
ADVICE = (
    ("test-weakest-workflows", "repo_confidence < threshold"),
    ("add-tests", "low_test_presence > 0"),
    ("cover-dynamic-calls", "call_rate < 0.9 or unresolved_calls > 0 or dynamic_calls > 0"),
    ("resolve-imports", "unresolved_imports > 0"),
    ("point-scripts-at-files", "unmapped_scripts > 0"),
    ("document-environment", "env_keys > 0 and not env_example"),
    ("support-languages", "unsupported_files > 0"),
    ("annotate-entry-points", "heuristic_files > 0"),
)


def recommendations(facts: DataFrame) -> DataFrame:
    """(ord, advice) for one row of facts; "nothing" if no fact calls for any.
    A null fact calls for none."""
    said = F.array_compact(F.array(*[F.when(F.expr(fact), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("advice"))) for k, (name, fact) in enumerate(ADVICE, 1)]))
    none = F.array(F.struct(F.lit(len(ADVICE) + 1).alias("ord"), F.lit("nothing").alias("advice")))
    return facts.select(F.explode(F.when(F.size(said) > 0, said).otherwise(none)).alias("a")).select("a.*")


def assemble_context(parts: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Parts of a context packed into a budget by the priority of their kind,
    then their order; empty texts and repeats fall out. parts: keys, kind (a
    name of CONTEXT_PRIORITIES; others are left out), ord, text."""
    rank = reduce(lambda out, k: F.when(F.col("kind") == k, CONTEXT_PRIORITIES[k]).otherwise(out), CONTEXT_PRIORITIES, F.lit(None).cast("double"))
    return pack(parts.withColumn("priority", rank).where("priority is not null"), budget, keys)
