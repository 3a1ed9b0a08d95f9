"""Mixing sources to target weights by subset-sum budget fitting.

Sources, in code point order with null last, get the weights in turn. Shares of
``ratio`` times all words that exceed ``most`` times a source's size are capped
and the excess is dealt again by weight. A source's target is met by whole
epochs of its documents plus a subset of exact size for what is left over:

1. documents are counted by exact length, for each source;
2. the same fraction of each length is taken, and a bounded-knapsack dynamic
   programme over the counts that remain fills the rest of the budget to the
   word, or as near below as any subset comes;
3. documents of each length are chosen by a seeded hash, by count.

The counts are aggregated before they meet: a source's part of the plan is a
row for each distinct length, bounded by the longest text. Choosing works in
hash cells of a (source, length): whole cells are taken or left by their
counts, and only the one where the quota ends is ordered, so that a third of
all rows sharing one source and one length doesn't meet in one task.

Defined results: null and wordless texts have size 0 and are never taken; the
null source is a source; rows that repeat are separate documents; a table
without words gives targets of 0. The source table (a row for each source) is
the mix's configuration and the one thing that comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 17
MARK = 64  # states of the knapsack between those that are kept


def word_count(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], ratio: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares by weight of ratio * sum(sizes), none above most * its size."""
    left, free, out = ratio * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(weights[k] for k in sorted(free))
        over = [k for k in sorted(free) if unit * weights[k] > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            free.discard(k)
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that the sum is as near to
    the budget as a subset can come from below.

    A proportional start keeps the length profile; the rest is an exact
    bounded knapsack over the remaining counts, on bit sets of reachable sums.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.astype(np.int64).copy()
    taken = (counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * taken).sum())
    longest = int(lengths.max())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # one more of each length, longest first, while much is left
        if rest <= 4 * longest:
            break
        if taken[i] < counts[i] and lengths[i] <= rest:
            taken[i] += 1
            rest -= int(lengths[i])
    while rest > 4 * longest:  # counts of the same length in bulk
        before = rest
        for i in order:
            n = min(int(counts[i] - taken[i]), max(0, (rest - 2 * longest) // int(lengths[i])))
            taken[i] += n
            rest -= n * int(lengths[i])
        if rest == before:
            break
    if rest <= 0:
        return taken
    limit = (1 << (rest + 1)) - 1
    state, items, marks = 1, [], {0: 1}
    for i in order[::-1]:  # short lengths first: they reach most sums
        n, size, k = int(min(counts[i] - taken[i], rest // int(lengths[i]))), int(lengths[i]), 1
        while n > 0 and not state >> rest & 1:
            k = min(k, n)
            state = (state | state << k * size) & limit
            items.append((i, k))
            if len(items) % MARK == 0:
                marks[len(items)] = state
            n, k = n - k, 2 * k
        if state >> rest & 1:
            break
    at = state.bit_length() - 1
    for mark in sorted(marks, reverse=True):  # states between two marks are made again
        states = [marks[mark]]
        block = items[mark : mark + MARK]
        for i, k in block[:-1]:
            states.append((states[-1] | states[-1] << k * int(lengths[i])) & limit)
        for (i, k), before in zip(reversed(block), reversed(states[: len(block)]), strict=True):
            if not before >> at & 1:
                taken[i] += k
                at -= k * int(lengths[i])
    return taken


def _keyed(docs: DataFrame, seed: int, cells: int) -> DataFrame:
    """docs with each row's size, source, draw and hash cell."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return docs.withColumns({
        "size": word_count(F.col("text")), "mix_null": F.col("source").isNull(), "mix_source": F.coalesce(F.col("source"), F.lit("")),
        "mix_draw": draw, "mix_cell": F.pmod(F.shiftrightunsigned(draw, 20), F.lit(cells)).cast("int"),
    })


def _taken(keyed: DataFrame, weights: tuple[float, ...], ratio: float, most: float) -> DataFrame:
    """keyed rows with source_size, target and taken."""
    spark = keyed.sparkSession
    key = ["mix_source", "mix_null", "size"]
    counted = cut(keyed.groupBy(*key, "mix_cell").agg(F.count("*").alias("n")), "mix-counts")
    shape = counted.groupBy(*key).agg(F.sum("n").alias("n"))
    found = shape.groupBy("mix_source", "mix_null").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()
    found.sort(key=lambda r: (r.mix_null, r.mix_source))
    goal = targets([r.total for r in found], [weights[k % len(weights)] for k in range(len(found))], ratio, most)
    plan = spark.createDataFrame(
        [(r.mix_source, r.mix_null, int(r.total), float(t)) for r, t in zip(found, goal, strict=True)],
        "mix_source string, mix_null boolean, source_size long, target double",
    )

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, goal = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
        whole = min(int(goal // size), int(most)) if size else 0
        some = rows["size"].to_numpy() > 0
        pick = np.zeros(len(rows), np.int64)
        if whole < most:
            lengths, n, budget = rows["size"].to_numpy()[some], rows.n.to_numpy()[some], round(goal) - whole * size
            chosen = fit_budget(lengths, n, budget)
            rest = budget - int((lengths * chosen).sum())
            over = np.flatnonzero((chosen < n) & (lengths < 2 * rest))
            if len(over):  # one more overshoots by less than leaving it falls short
                chosen[over[lengths[over].argmin()]] += 1
            pick[some] = chosen
        return rows[["mix_source", "mix_null", "size", "source_size", "target"]].assign(whole=whole, quota=pick)

    quota = cut(
        shape.join(F.broadcast(plan), ["mix_source", "mix_null"]).groupBy("mix_source", "mix_null")
        .applyInPandas(quotas, "mix_source string, mix_null boolean, size long, source_size long, target double, whole int, quota long"),
        "mix-quota",
    )
    before = Window.partitionBy(*key).orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    filled = counted.join(quota, key).withColumn("room", F.col("quota") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*key, "mix_cell").orderBy("mix_draw", "doc_id"))
    return (
        keyed.withColumn("mix_rank", rank)
        .join(filled.drop("n", "quota").hint("merge"), [*key, "mix_cell"])
        .withColumn("taken", F.col("size") * (F.col("whole") + (F.col("mix_rank") <= F.col("room")).cast("int")))
        .drop("mix_source", "mix_null", "mix_draw", "mix_cell", "mix_rank", "room", "whole")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, most: float = 2.0, seed: int = SEED, cells: int = 256) -> DataFrame:
    """All columns of docs with size, source_size, target and taken (words);
    columns of docs that have these names give way."""
    own = docs.drop("size", "source_size", "target", "taken")
    return _taken(_keyed(own, seed, cells), weights, ratio, most)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ratio: float = 1.5, most: float = 2.0, seed: int = SEED, cells: int = 256) -> DataFrame:
    """doc_id, size, source_size, target, taken; texts are read once and stay
    where they are."""
    keyed = cut(_keyed(docs.select("doc_id", "source", "text"), seed, cells).drop("text", "source"), "mix-sizes")
    return _taken(keyed, weights, ratio, most).select("doc_id", "size", "source_size", "target", "taken")
