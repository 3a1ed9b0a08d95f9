"""Weighted composites over long signal tables, with nulls as unavailable.

Signals are rows (workflow, signal, value, weight); a null value is unavailable
and its weight is dealt to the others. Scores stay unrounded doubles until
output, because thresholds compare them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"parseIntegrity": 0.30, "resolutionRate": 0.25, "testPresence": 0.25, "stability": 0.10}
COVERAGE_WEIGHT = 0.1


def workflow_scores(signals: DataFrame, keys: tuple[str, ...] = ("workflow",)) -> DataFrame:
    """score and signal_coverage of each workflow; null score without signals.

    signal_coverage is the available share of all weights.
    """
    there = F.col("value").isNotNull()
    return signals.groupBy(*keys).agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum(F.when(there, F.col("weight")))).alias("score"),
        (F.sum(F.when(there, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("signal_coverage"),
    )


def ratio(part, whole) -> F.Column:
    """part / whole, and 1 for nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))


def repo_confidence(scores: DataFrame, sizes: DataFrame, covered, files) -> DataFrame:
    """One row: the size-weighted mean of the scores and the coverage term.

    sizes: workflow, n_files. covered and files are numbers or scalar columns.
    """
    joined = scores.where("score is not null").join(sizes, "workflow")
    mean = joined.agg((F.sum(F.col("score") * F.col("n_files")) / F.sum("n_files")).alias("mean"))
    cover = ratio(F.lit(covered).cast("double"), F.lit(files).cast("double"))
    return mean.select(F.col("mean"), cover.alias("coverage"), ((1 - COVERAGE_WEIGHT) * F.coalesce("mean", F.lit(0.0)) + COVERAGE_WEIGHT * cover).alias("repo_confidence"))


def explain(signals: DataFrame) -> DataFrame:
    """Per signal its effective weight, contribution and cost; contributions
    sum to the score, and contribution + cost is the effective weight."""
    w = Window.partitionBy("workflow")
    there = F.col("value").isNotNull()
    effective = F.when(there, F.col("weight") / F.sum(F.when(there, F.col("weight"))).over(w)).otherwise(0.0)
    return signals.withColumn("effective", effective).select(
        "workflow", "signal", "value", "weight", "effective",
        (F.col("effective") * F.coalesce("value", F.lit(0.0))).alias("contribution"),
        (F.col("effective") * (1 - F.coalesce("value", F.lit(0.0)))).alias("cost"),
        (~there).alias("unavailable"),
    )


def simulate(signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Before, after and delta per workflow when some signals take other
    values; workflows whose score stays are dropped. overrides: workflow,
    signal, new_value. One plan, no copies of the data."""
    changed = signals.join(overrides, ["workflow", "signal"], "left").withColumn("value_after", F.coalesce("new_value", "value"))
    before = workflow_scores(signals).select("workflow", F.col("score").alias("before"))
    after = workflow_scores(changed.select("workflow", "signal", F.col("value_after").alias("value"), "weight")).select("workflow", F.col("score").alias("after"))
    return before.join(after, "workflow").withColumn("delta", F.col("after") - F.col("before")).where("abs(delta) > 1e-9")


def unmatched(overrides: DataFrame, signals: DataFrame) -> DataFrame:
    """Overrides that name no signal."""
    return overrides.join(signals.select("workflow", "signal").distinct(), ["workflow", "signal"], "left_anti")


def ceiling(signals: DataFrame, held: tuple[str, ...] = ("stability",), caps: DataFrame | None = None) -> DataFrame:
    """Score if every available signal reached 1, or its cap; held ones stay.

    caps: workflow, signal, cap.
    """
    if caps is not None:
        signals = signals.join(caps, ["workflow", "signal"], "left")
    else:
        signals = signals.withColumn("cap", F.lit(None).cast("double"))
    best = F.when(F.col("value").isNull() | F.col("signal").isin(*held), F.col("value")).otherwise(F.greatest(F.col("value"), F.coalesce("cap", F.lit(1.0))))
    top = workflow_scores(signals.withColumn("best", best).select("workflow", "signal", F.col("best").alias("value"), "weight"))
    return workflow_scores(signals).select("workflow", "score").join(top.select("workflow", F.col("score").alias("ceiling")), "workflow")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Contribution deltas per signal of two snapshots, added or removed
    workflows marked, largest change first."""
    a = explain(before).select("workflow", "signal", F.col("contribution").alias("was"))
    b = explain(after).select("workflow", "signal", F.col("contribution").alias("now"))
    both = a.join(b, ["workflow", "signal"], "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("kept")
    return both.select("workflow", "signal", "was", "now", (F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))).alias("delta"), state.alias("state"))


def weak_signals(signals: DataFrame, below: float = 0.7) -> DataFrame:
    """Signals that are unavailable or low."""
    return signals.where(F.col("value").isNull() | (F.col("value") < below))
