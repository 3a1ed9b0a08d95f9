"""Reachability kept up to date under changes of edges and starts.

The closure is the result of :func:`loomgraph.operators.graph.reach`: (start,
node, depth). A change first takes away the pairs that lost their support, by
rising depth: a pair is supported by an edge from a pair of the start that is one
step nearer and itself kept. What was taken away is then derived again from its
kept neighbours, new edges and starts offer shorter ways, and improvements spread
until none is left. Rows that no change touches are neither grouped nor sorted
again: they are only joined against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard


def maintain(closure: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, new_starts: DataFrame | None = None, gone_starts: DataFrame | None = None) -> DataFrame:
    """The closure after a change. closure: start, node, depth over ``edges``
    (src, dst); added, removed: src, dst; new_starts, gone_starts: start.

    Edges that are both added and removed stay. Null ends and repeats add nothing.
    """
    clean = lambda df: df.select("src", "dst").where("src is not null and dst is not null").distinct()
    old = cut(clean(edges), "edges")
    plus = cut(clean(added), "edges-added")
    minus = cut(clean(removed).join(plus, ["src", "dst"], "left_anti").join(old, ["src", "dst"], "left_semi"), "edges-removed")
    now = cut(old.join(minus, ["src", "dst"], "left_anti").unionByName(plus).distinct(), "edges-now")
    if gone_starts is not None:
        closure = closure.join(gone_starts.select("start").distinct(), "start", "left_anti")
    held = cut(closure.select("start", "node", "depth"), "closure")
    at = lambda name, depth: held.select("start", F.col("node").alias(name), F.col("depth").alias(depth))

    def behind(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs one step behind rows (start, node, depth), by links."""
        tight = rows.select("start", F.col("node").alias("src"), "depth").join(links, "src").select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
        return tight.join(held, ["start", "node", "depth"], "left_semi").distinct()

    def from_removed() -> DataFrame:
        ends = minus.join(at("src", "depth"), "src").select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
        return ends.join(held, ["start", "node", "depth"], "left_semi").distinct()

    waiting = cut(from_removed(), "waiting")
    lost: list[DataFrame] = []
    while not waiting.isEmpty():
        depth = waiting.agg(F.min("depth")).first()[0]
        here = waiting.where(F.col("depth") == depth)
        near = here.select("start", F.col("node").alias("dst"), "depth").join(now, "dst").join(at("src", "src_depth"), ["start", "src"]).where("src_depth + 1 = depth")
        for part in lost[-1:]:  # those one step nearer that went
            near = near.join(part.select("start", F.col("node").alias("src"), F.col("depth").alias("src_depth")), ["start", "src", "src_depth"], "left_anti")
        gone = cut(here.join(near.select("start", F.col("dst").alias("node")).distinct(), ["start", "node"], "left_anti"), "lost")
        later = behind(gone, now).unionByName(waiting.where(F.col("depth") > depth)).distinct()
        before, waiting = waiting, cut(later, "waiting")
        discard(before)
        lost.append(gone)
    kept = held
    all_lost = None
    if lost:
        all_lost = lost[0]
        for part in lost[1:]:
            all_lost = all_lost.unionByName(part)
        all_lost = cut(all_lost, "all-lost")
        kept = cut(held.join(all_lost.select("start", "node"), ["start", "node"], "left_anti"), "kept")
    of = lambda name, depth: kept.select("start", F.col("node").alias(name), F.col("depth").alias(depth))
    offers = plus.join(of("src", "d"), "src").select("start", F.col("dst").alias("node"), (F.col("d") + 1).alias("depth"))
    if all_lost is not None:
        again = all_lost.select("start", F.col("node").alias("dst")).join(now, "dst").join(of("src", "d"), ["start", "src"])
        offers = offers.unionByName(again.select("start", F.col("dst").alias("node"), (F.col("d") + 1).alias("depth")))
    if new_starts is not None:
        fresh = new_starts.select("start").where("start is not null").distinct()
        offers = offers.unionByName(fresh.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    better: DataFrame | None = None
    while True:
        best = offers.groupBy("start", "node").agg(F.min("depth").alias("depth"))
        known = kept if better is None else kept.unionByName(better)
        was = known.join(best.select("start", "node"), ["start", "node"], "left_semi").groupBy("start", "node").agg(F.min("depth").alias("was"))
        step = cut(best.join(was, ["start", "node"], "left").where("was is null or depth < was").select("start", "node", "depth"), "better")
        if step.isEmpty():
            break
        better = step if better is None else cut(better.unionByName(step).groupBy("start", "node").agg(F.min("depth").alias("depth")), "better-all")
        offers = step.select("start", F.col("node").alias("src"), "depth").join(now, "src").select("start", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))
    if better is None:
        return kept
    return kept.join(better.select("start", "node"), ["start", "node"], "left_anti").unionByName(better)
