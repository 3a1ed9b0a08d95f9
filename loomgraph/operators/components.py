"""Connected components by local forests and star contraction.

Every task replaces the edges it holds by a spanning forest, so that a
component costs an edge for each of its nodes and task. Forests are gathered
into parts of at most ``part`` edges. Where one part holds all that is left, its
forest is the answer; else rounds of star contraction (two aggregations with
map-side minima, two joins salted at hubs) and further local forests go on until
nothing changes. Rounds are written to the shared folder: lost executors cost
one round, and lineage stays flat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

MAX_ROUNDS, PART, HUB = 60, 1 << 18, 1 << 17


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each of n nodes: the first node of its component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(k) for k in range(n)], np.int64) if n else np.zeros(0, np.int64)


def _forest(edges: DataFrame, part: int) -> DataFrame:
    """(a, b): every node of the edges of a task with its root there."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= part:
                yield solve(held)
                held, rows = [], 0
        if rows:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        both = pa.chunked_array(t["a"].chunks + t["b"].chunks).combine_chunks().dictionary_encode()
        names = both.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        at = place[both.indices.to_numpy()]
        root = spanning(len(names), at[: t.num_rows], at[t.num_rows :])
        sorted_names = both.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([sorted_names, sorted_names.take(pa.array(root))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(a, b, m) for the edges; a node of many edges is dealt out by salts. At
    most one node in HUB edges is such a hub, so their table is small."""
    salted = low.withColumn("salts", F.ceil(F.col("n") / HUB).cast("int"))
    hubs = salted.where("salts > 1").select("a", "salts")
    left = edges.join(F.broadcast(hubs), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = salted.select("a", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", part: int = PART) -> DataFrame:
    """(node, component) for every node of an edge list; component is the
    smallest node reachable. Null ends and self-loops add nothing but, for a
    self-loop, the node itself.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    first = cut(_forest(ends, part), "cc")
    now, state = first, _state(first)
    for _ in range(MAX_ROUNDS):
        if state[0] <= part:
            done = cut(_forest(now.coalesce(1) if state[0] else now, 1 << 62), "cc")
            break
        after = cut(_forest(_small_star(_large_star(now.where("a <> b"))), part).where("a <> b"), "cc")
        if now is not first:
            discard(now)
        before, now, state = state, after, _state(after)
        if state == before:
            done = now.unionByName(now.select(F.col("b").alias("a"), "b").distinct())
            break
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    found = done.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if now is first:
        return found
    alone = first.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("node")))
