"""A work plan from what lowers the scores: five kinds of tasks, their gain, and
the best of them within a budget.

Relations: files (file, parser_kind, parsed, parse_errors, n_exports);
workflow_files (workflow, file); credit (file, status); calls (file,
resolution); orphans (file); signals (workflow, signal, value, weight).

A task's lift is what the repository's score gains by it alone. The score is
linear in each signal, and a signal that is a mean over files is linear in each
file, so all lifts come from one aggregation and no task is simulated by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import greedy_fill
from .score import COVERAGE_WEIGHT, simulate, workflow_scores

TASK = ("id", "kind", "file", "signal", "risk", "effort", "lift")
RISKS = ("low", "medium", "high")
#: fixed values: minutes and risk by kind; orphans that one plan wires in
MINUTES = {"add-test": 15, "replace-padding": 20, "fix-parse": 15, "wire-coverage": 15}
PER_EXPORT, MOST_EXPORTS, PER_CALL, MOST_CALLS, WIRED = 5, 5, 10, 240, 5


def _effective(signals: DataFrame) -> DataFrame:
    """(workflow, signal, value, effective): a signal's share of the available
    weight of its workflow."""
    there = F.col("value").isNotNull()
    all_there = F.sum(F.when(there, F.col("weight"))).over(Window.partitionBy("workflow"))
    return signals.where("weight > 0").withColumn("effective", F.col("weight") / all_there).where(there)


def _totals(workflow_files: DataFrame) -> DataFrame:
    """One row: memberships, and files in any workflow."""
    return workflow_files.agg(F.count("*").alias("memberships"), F.countDistinct("file").alias("covered"))


def _tasks(rows: DataFrame, kind: Column, signal: str, risk: str, effort: Column, lift: Column) -> DataFrame:
    #: equal lifts must tie: they are rounded
    return rows.select(F.concat_ws(":", kind, "file").alias("id"), kind.alias("kind"), "file", F.lit(signal).alias("signal"), F.lit(risk).alias("risk"), effort.cast("double").alias("effort"), F.round(lift, 9).alias("lift"))


def improvement_candidates(files: DataFrame, workflow_files: DataFrame, credit: DataFrame, calls: DataFrame, orphans: DataFrame, signals: DataFrame) -> DataFrame:
    """TASK rows of all five kinds, those without gain among them.

    add-test and replace-padding: files in a workflow that no test covers, or
    only one of a like name. fix-parse: parsed files with errors. resolve-calls:
    one task for all unresolved calls. wire-coverage: the first orphans by name,
    each counted on top of those before it.
    """
    member = workflow_files.select("workflow", "file").distinct()
    share = _effective(signals)
    scale = (1 - F.lit(COVERAGE_WEIGHT)) / F.col("memberships")
    totals = F.broadcast(_totals(member))  # one row

    def by_file(rows: DataFrame, signal: str) -> DataFrame:
        own = share.where(F.col("signal") == signal).select("workflow", "effective")
        gained = member.join(own, "workflow").groupBy("file").agg(F.sum("effective").alias("gain"))
        return rows.join(gained, "file").crossJoin(totals)

    untested = credit.where(F.col("status").isin("untested", "tested-nameonly")).join(files.select("file", "n_exports"), "file", "left")
    new = F.col("status") == "untested"
    exports = F.least(F.coalesce("n_exports", F.lit(0)), F.lit(MOST_EXPORTS))
    effort = F.when(new, MINUTES["add-test"] + PER_EXPORT * exports).otherwise(MINUTES["replace-padding"])
    tests = _tasks(by_file(untested, "testPresence"), F.when(new, "add-test").otherwise("replace-padding"), "testPresence", "low", effort, F.col("gain") * scale)
    broken = files.where("parser_kind <> 'heuristic' and parsed and parse_errors > 0")
    parses = _tasks(by_file(broken, "parseIntegrity"), F.lit("fix-parse"), "parseIntegrity", "medium", F.lit(MINUTES["fix-parse"]), F.col("gain") * scale)
    static = calls.where("resolution <> 'dynamic'").agg(F.count_if(F.col("resolution") == "unresolved").alias("unresolved"), F.count("*").alias("calls"))
    sizes = member.groupBy("workflow").agg(F.count("*").alias("n"))
    open_rate = share.where("signal = 'resolutionRate'").join(sizes, "workflow").agg(F.sum(F.col("effective") * (1 - F.col("value")) * F.col("n")).alias("gain"))
    resolve = static.crossJoin(open_rate).crossJoin(totals).where(F.col("unresolved") > F.col("calls") * 0.001).withColumn("file", F.lit(None).cast("string"))
    resolves = _tasks(resolve, F.lit("resolve-calls"), "resolutionRate", "medium", F.least(F.col("unresolved") * PER_CALL, F.lit(MOST_CALLS)), F.col("gain") * scale)
    first = orphans.select("file").distinct().orderBy("file").limit(WIRED)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("file")))  # WIRED rows at most
    total_files = F.broadcast(files.agg(F.greatest(F.lit(1), F.countDistinct("file")).alias("files")))
    wires = _tasks(placed.crossJoin(total_files), F.lit("wire-coverage"), "coverageOfRepo", "medium", F.lit(MINUTES["wire-coverage"]), F.lit(COVERAGE_WEIGHT) * F.col("place") / F.col("files"))
    return tests.unionByName(parses).unionByName(resolves).unionByName(wires)


def eligible(tasks: DataFrame, risk: str = "low") -> DataFrame:
    """Tasks with a gain and of no more than the given risk."""
    return tasks.where(F.col("risk").isin(*RISKS[: RISKS.index(risk) + 1]) & (F.col("lift") > 0))


def improvement_plan(tasks: DataFrame, budget: float, risk: str = "low") -> DataFrame:
    """The tasks taken within a budget of minutes."""
    fit = eligible(tasks, risk).withColumn("_plan", F.lit(0))
    taken = greedy_fill(fit, budget, ["_plan"]).select("id")
    return fit.drop("_plan").join(taken, "id", "left_semi")


def planned_overrides(plan: DataFrame, workflow_files: DataFrame, signals: DataFrame) -> DataFrame:
    """(workflow, signal, new_value): the signals once a plan's tasks are done."""
    member = workflow_files.select("workflow", "file").distinct()
    sizes = member.groupBy("workflow").agg(F.count("*").alias("n"))
    done = plan.where(F.col("signal").isin("testPresence", "parseIntegrity")).join(member, "file").groupBy("workflow", "signal").agg(F.count("*").alias("done"))
    raised = done.join(sizes, "workflow").join(signals, ["workflow", "signal"]).select("workflow", "signal", F.least(F.lit(1.0), F.col("value") + F.col("done") / F.col("n")).alias("new_value"))
    resolved = plan.where("kind = 'resolve-calls'").select("signal").join(signals.where("value is not null"), "signal").select("workflow", "signal", F.lit(1.0).alias("new_value"))
    return raised.unionByName(resolved)


def projection(plan: DataFrame, files: DataFrame, workflow_files: DataFrame, signals: DataFrame) -> DataFrame:
    """One row (before, after, lift, tasks, effort): the repository's score now
    and with all of a plan done together."""
    member = workflow_files.select("workflow", "file").distinct()
    sizes = member.groupBy("workflow").agg(F.count("*").alias("n"))
    now = workflow_scores(signals).where("score is not null").join(sizes, "workflow")
    moved = simulate(signals, planned_overrides(plan, member, signals)).select("workflow", "after")
    scored = now.join(moved, "workflow", "left").agg(
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.coalesce("after", "score") * F.col("n")) / F.sum("n")).alias("mean_after"))
    wired = plan.agg(F.count_if(F.col("kind") == "wire-coverage").alias("wired"), F.count("*").alias("tasks"), F.coalesce(F.sum("effort"), F.lit(0.0)).alias("effort"))
    count = files.agg(F.greatest(F.lit(1), F.countDistinct("file")).alias("files"))
    one = scored.crossJoin(wired).crossJoin(_totals(member)).crossJoin(count)  # one row each
    score = lambda mean, extra: (1 - COVERAGE_WEIGHT) * F.coalesce(mean, F.lit(0.0)) + COVERAGE_WEIGHT * (F.col("covered") + extra) / F.col("files")
    before, after = score("mean", F.lit(0)), score("mean_after", F.col("wired"))
    return one.select(before.alias("before"), after.alias("after"), (after - before).alias("lift"), "tasks", "effort")
