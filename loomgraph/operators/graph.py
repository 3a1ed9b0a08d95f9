"""Reachability, cycles, shortest chains and degrees over edge tables.

Edges are DataFrames (src, dst). Loops are frontier joins over edges that are
written once; every round is written to the shared folder, so lineage stays flat
and lost executors cost a round. Loops go on until nothing is left to do, however
long a path is; a bound, where one is given, raises instead of returning a part.
Graphs of at most SMALL edges are solved by one task, with the same result.

Larger ones are compressed first: a chain of nodes with one edge in and one out
becomes a single edge, found by pointers that double (:func:`compress`), so a path
of a million steps costs twenty rounds and not a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard

SMALL = 1 << 18
#: rows of a frontier that is broadcast; no table that grows is, because names
#: compress so well that Spark takes a million of them for a few megabytes
FEW = 1 << 14


def _rounds(most: int | None) -> Iterator[int]:
    for k in count(1):
        if most is not None and k > most:
            raise RuntimeError(f"not done after {most} rounds")
        yield k


def reach(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(start, node, depth) for all nodes reachable from each start, itself at 0."""
    steps = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "reach-edges")
    frontier = cut(starts.select(F.col("start"), F.col("start").alias("node")).where("start is not null").distinct().withColumn("depth", F.lit(0)), "reach")
    seen, parts, n = frontier, 1, frontier.count()
    for depth in _rounds(rounds):
        by = F.broadcast(frontier) if n <= FEW else frontier.hint("merge")
        near = steps.join(by, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(near.join(seen.hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        n = frontier.count()
        if not n:
            return seen
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts > 8:  # a long chain of unions is planned again in every round
            seen, parts = cut(seen, "reach-seen"), 1


def uncovered(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes that no start reaches."""
    return nodes.join(reached.select("node").distinct(), "node", "left_anti")


def _in_one_task(edges: DataFrame, solve, schema: str) -> DataFrame:
    """solve(rows of the edges), a generator of rows, in a single task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found = list(solve(rows))
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], schema=arrow)

    return edges.coalesce(1).mapInArrow(run, schema)


def strong_components(rows: list[tuple]) -> Iterator[tuple]:
    """(member, label) of strongly connected sets; the label is the smallest
    member. Two passes over the graph, without recursion: an order of leaving,
    then sets of the reverse graph in that order."""
    out: dict = {}
    back: dict = {}
    for a, b in rows:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
        out.setdefault(b, [])
        back.setdefault(a, [])
    left, seen = [], set()
    for start in out:
        if start in seen:
            continue
        seen.add(start)
        todo = [(start, iter(out[start]))]
        while todo:
            node, rest = todo[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                left.append(node)
                todo.pop()
            else:
                seen.add(step)
                todo.append((step, iter(out[step])))
    done: set = set()
    for start in reversed(left):
        if start in done:
            continue
        done.add(start)
        members, todo = [], [start]
        while todo:
            node = todo.pop()
            members.append(node)
            more = [x for x in back[node] if x not in done]
            done.update(more)
            todo.extend(dict.fromkeys(more))
        if len(members) > 1:
            low = min(members)
            for node in members:
                yield node, low


@dataclass
class Compressed:
    """A graph whose chains are edges, and the chains.

    edges: src, dst, weight (steps), first (a chain's first node, null for an
    edge); chains: node, first, off (steps from first), prev, head (the node
    before the chain), tail (the node after it); rings: node, low (rings apart
    from all else, by their smallest node).
    """

    edges: DataFrame
    chains: DataFrame
    rings: DataFrame


def compress(edges: DataFrame, keep: DataFrame | None = None) -> Compressed:
    """Chains of (src, dst) edges as single edges. Nodes of ``keep`` (node) end
    chains. edges: distinct, without self edges."""
    come = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("prev")).where("n = 1")
    go = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("m"), F.min("dst").alias("after")).where("m = 1")
    inner = come.join(go.hint("merge"), "node").select("node", "prev", "after")
    if keep is not None:
        inner = inner.join(keep.select("node"), "node", "left_anti")
    inner = cut(inner, "chains")
    known = inner.select(F.col("node").alias("prev"), F.lit(True).alias("inside"))
    begun = F.col("inside").isNull()
    state = inner.join(known.hint("merge"), "prev", "left").select("node", F.when(~begun, F.col("prev")).alias("ptr"), F.when(begun, F.col("node")).alias("first"), F.when(begun, 0).otherwise(1).cast("long").alias("off"), F.least("node", "prev").alias("low"))
    state = cut(state, "chains")
    rounds = inner.count().bit_length() + 1
    for _ in range(rounds):
        open_ones = state.where("ptr is not null")
        if open_ones.isEmpty():
            break
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("first").alias("first2"), F.col("off").alias("off2"), F.col("low").alias("low2"))
        moved = open_ones.join(ahead.hint("merge"), "ptr").select("node", F.col("ptr2").alias("ptr"), F.col("first2").alias("first"), (F.col("off") + F.col("off2")).alias("off"), F.least("low", "low2").alias("low"))
        before, state = state, cut(state.where("ptr is null").unionByName(moved), "chains")
        discard(before)
    done = state.where("ptr is null").select("node", "first", "off").join(inner.hint("merge"), "node")
    ends = done.join(known.select(F.col("prev").alias("after"), "inside").hint("merge"), "after", "left").where("inside is null").select("first", F.col("after").alias("tail"), (F.col("off") + 2).alias("weight"))
    heads = done.where("off = 0").select("first", F.col("prev").alias("head"))
    spans = cut(heads.join(ends.hint("merge"), "first"), "spans")
    chains = cut(done.select("node", "first", "off", "prev").join(spans.select("first", "head", "tail").hint("merge"), "first"), "chains")
    rings = cut(state.where("ptr is not null").select("node", "low"), "rings")
    #: what remains of the edges has no inner node at either end
    within = inner.select("node")
    direct = edges.join(within.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(within.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti")
    kind = edges.schema["src"].dataType
    short = direct.select("src", "dst", F.lit(1).cast("long").alias("weight"), F.lit(None).cast(kind).alias("first"))
    whole = cut(short.unionByName(spans.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "weight", "first")), "compressed")
    for used in (inner, state, spans):
        discard(used)
    return Compressed(whole, chains, rings)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends have edges in and out: others are in no cycle."""
    return edges.join(edges.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst")


def _core_components(left: DataFrame) -> DataFrame:
    """(node, start) of some of the components of a graph that neither trimming
    nor compressing makes smaller: every node takes the smallest label that
    reaches it, and the nodes that reach their label's node inside the label's
    set are one component."""
    label = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("label", F.col("node")), "scc")
    moving = True
    while moving:
        low = left.join(label.hint("merge"), left.src == label.node).groupBy("dst").agg(F.min("label").alias("low"))
        after = label.join(low.hint("merge"), label.node == low.dst, "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"))
        #: a label's own label is one that reaches it, so that it reaches all of them as well
        jump = after.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = after.join(jump.hint("merge"), "label").select("node", F.least("label", "next").alias("label"))
        after = cut(after.join(label.select("node", F.col("label").alias("was")).hint("merge"), "node").select("node", "label", (F.col("label") < F.col("was")).alias("moved")), "scc")
        discard(label)
        moving, label = not after.where("moved").isEmpty(), after.drop("moved")
    own = left.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")).hint("merge"), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")).hint("merge"), "dst").where("a = b")
    back = reach(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), label.where("node = label").select(F.col("label").alias("start")))
    return cut(back.join(label.withColumnRenamed("label", "start").hint("merge"), ["start", "node"]).select("node", "start"), "scc")


def cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(cycle, members): strongly connected sets of two or more nodes, and self
    loops; cycle is the smallest member.

    Until at most ``small`` edges are left, which one task solves, the graph is
    trimmed and compressed; what can't be made smaller gives up components. A
    chain belongs to a component that holds both its ends.
    """
    kind = edges.schema["src"].dataType.simpleString()
    all_edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "scc")
    loops = all_edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left = all_edges.where("src <> dst")
    found, levels = [], []
    n = left.count()
    while n > small:
        slim = cut(_trimmed(left), "scc")
        packed = compress(slim)
        if not packed.chains.isEmpty() or not packed.rings.isEmpty():
            found.append(packed.rings.select("node", F.col("low").alias("start")))
            levels.append(packed)
            left = cut(packed.edges.where("src <> dst").select("src", "dst").distinct(), "scc")
        elif slim.count() < n:
            left = slim
        else:
            part = _core_components(slim)
            found.append(part)
            gone = part.select("node")
            left = cut(slim.join(gone.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti").select("src", "dst"), "scc")
        n = left.count()
    found.append(_in_one_task(left, strong_components, f"node {kind}, start {kind}"))
    both = found[0]
    for part in found[1:]:
        both = both.unionByName(part)
    both = cut(both, "scc-labels")
    for packed in reversed(levels):
        #: a chain from a node to itself makes a component of a node that has none yet
        alone = packed.edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(both.hint("merge"), "node", "left_anti").withColumn("start", F.col("node"))
        both = cut(both.unionByName(alone), "scc-labels")
        end = lambda name: both.select(F.col("node").alias(name), F.col("start").alias(f"{name}_start"))
        inside = packed.chains.join(end("head").hint("merge"), "head").join(end("tail").hint("merge"), "tail").where("head_start = tail_start").select("node", F.col("head_start").alias("start"))
        both = cut(both.unionByName(inside), "scc-labels")
    sets = both.unionByName(loops.select("node", F.col("node").alias("start"))).groupBy("start").agg(F.array_sort(F.collect_set("node")).alias("members"))
    grouped = cut(sets, "scc-sets")
    inside = grouped.where("size(members) > 1").select(F.explode("members").alias("start"))
    real = grouped.where("size(members) > 1").unionByName(grouped.where("size(members) = 1").join(loops.withColumnRenamed("node", "start").hint("merge"), "start", "left_semi").join(inside.hint("merge"), "start", "left_anti"))
    return real.select(F.array_min("members").alias("cycle"), "members")


def chain_of(rows: list[tuple], source, target) -> Iterator[tuple]:
    """(step, src, dst, via) of the shortest chain over (src, dst, via) rows."""
    out: dict = {}
    for a, b, via in rows:
        out.setdefault(a, []).append((b, via))
    by, near = {source: None}, [source]
    while near and target not in by:
        reached: dict = {}
        for a in near:
            for b, via in out.get(a, ()):
                if b not in by and (b not in reached or (a, via) < reached[b]):
                    reached[b] = (a, via)
        by |= reached
        near = list(reached)
    steps = []
    while target in by and by[target] is not None:
        a, via = by[target]
        steps.append((a, target, via))
        target = a
    for k, (a, b, via) in enumerate(reversed(steps), 1):
        yield k, a, b, via


def _distances(edges: DataFrame, source, target, kind: str) -> DataFrame:
    """(node, depth) of the nodes that weighted edges reach from source, no
    farther than target."""
    spark = edges.sparkSession
    seen = cut(spark.createDataFrame([(source, 0)], f"node {kind}, depth long"), "path")
    frontier, parts, best = seen, 1, None
    while True:
        near = frontier.join(edges, frontier.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("weight")).alias("depth"))
        if best is not None:
            near = near.where(F.col("depth") <= best)
        known = seen.groupBy("node").agg(F.min("depth").alias("was"))
        frontier = cut(near.join(known, "node", "left").where("was is null or depth < was").select("node", "depth"), "path")
        if frontier.isEmpty():
            return seen.groupBy("node").agg(F.min("depth").alias("depth"))
        hit = frontier.where(F.col("node") == F.lit(target)).first()
        best = hit.depth if hit else best
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts > 8:
            seen, parts = cut(seen.groupBy("node").agg(F.min("depth").alias("depth")), "path-seen"), 1


def _line_of(parents: DataFrame, target) -> DataFrame:
    """(node, parent, ...) rows on the line from target to the root: tables of
    2^k-th ancestors, then all sums of powers of two."""
    jumps = [cut(parents.select("node", F.col("parent").alias("up")), "jump")]
    while True:
        last = jumps[-1]
        longer = cut(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up")), "jump")
        if longer.isEmpty():
            break
        jumps.append(longer)
    line = parents.where(F.col("node") == F.lit(target)).select("node")
    for jump in reversed(jumps):
        line = cut(line.unionByName(line.join(jump, "node").select(F.col("up").alias("node"))), "line")
    out = cut(parents.join(line.distinct(), "node", "left_semi"), "line")
    for jump in jumps:
        discard(jump)
    return out


def shortest_path(edges: DataFrame, source, target, small: int = SMALL) -> DataFrame:
    """(step, src, dst, via) of a shortest chain; no rows if there is none.

    edges: src, dst, via. Self edges are dropped; among equals the smallest
    (src, via) comes first, so the chain is defined. Beyond ``small`` edges
    chains are compressed, and the chain is read by pointers that double.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    schema = f"step int, src {kind}, dst {kind}, via string"
    steps = cut(edges.select("src", "dst", "via").where("src <> dst").distinct(), "path-edges")
    if steps.count() <= small:
        return _in_one_task(steps, lambda rows: chain_of(rows, source, target), schema)
    if source == target:
        return spark.createDataFrame([], schema)
    single = cut(steps.groupBy("src", "dst").agg(F.min("via").alias("via")), "path-edges")
    ends = spark.createDataFrame([(source,), (target,)], f"node {kind}")
    packed = compress(single.select("src", "dst"), ends)
    depth = cut(_distances(packed.edges, source, target, kind), "path-depths")
    if depth.where(F.col("node") == F.lit(target)).isEmpty():
        return spark.createDataFrame([], schema)
    inner = packed.chains.join(depth.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("off") + 1).alias("depth"), "head", "first")
    at = depth.select("node", "depth", F.lit(None).cast(kind).alias("head"), F.lit(None).cast(kind).alias("first")).unionByName(inner)
    #: the step into each end of chains: of the smallest of those that come in time
    late = single.join(at.select(F.col("node").alias("src"), F.col("depth").alias("src_depth"), F.col("head"), F.col("first")), "src").join(depth.withColumnRenamed("node", "dst"), "dst")
    best = late.where("src_depth + 1 = depth").groupBy("dst", "depth").agg(F.min(F.struct("src", "via", "head", "first")).alias("by"))
    parents = cut(best.select(F.col("dst").alias("node"), F.coalesce("by.head", "by.src").alias("parent"), F.col("by.src").alias("src"), F.col("by.via").alias("via"), F.col("by.first").alias("first"), "depth"), "parents")
    line = _line_of(parents, target)
    last = line.select(F.col("depth").cast("int").alias("step"), "src", F.col("node").alias("dst"), "via")
    used = line.where("first is not null").select("first", F.col("depth").alias("end"))
    chain = packed.chains.join(used, "first").join(depth.withColumnRenamed("node", "head"), "head")
    within = chain.select((F.col("depth") + F.col("off") + 1).cast("int").alias("step"), F.col("prev").alias("src"), F.col("node").alias("dst"))
    return last.unionByName(within.join(single, ["src", "dst"]).select("step", "src", "dst", "via"))


def trace_path(edges: DataFrame, source, target) -> DataFrame:
    """(direction, step, src, dst, via): the chain from source to target, else
    the one from target to source; no rows if neither reaches the other."""
    forward = cut(shortest_path(edges, source, target), "trace")
    if source == target or not forward.isEmpty():
        return forward.select(F.lit("forward").alias("direction"), "*")
    return shortest_path(edges, target, source).select(F.lit("reverse").alias("direction"), "*")


def trace_files(files: DataFrame, workflow_files: DataFrame, edges: DataFrame, buckets: DataFrame) -> DataFrame:
    """Why each file is in a workflow or isn't: file, in_workflow, workflows,
    importers, classification.

    edges: src, dst; buckets: file, bucket for files that no workflow holds. A
    file that has neither is uncovered.
    """
    held = workflow_files.groupBy("file").agg(F.array_sort(F.collect_set("workflow")).alias("workflows"))
    used = edges.groupBy(F.col("dst").alias("file")).agg(F.array_sort(F.collect_set("src")).alias("importers"))
    known = buckets.groupBy("file").agg(F.min("bucket").alias("bucket"))
    all_in = files.select("file").distinct().join(held, "file", "left").join(used, "file", "left").join(known, "file", "left")
    inside = F.col("workflows").isNotNull()
    empty = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)
    return all_in.select("file", inside.alias("in_workflow"), empty("workflows", held), empty("importers", used), F.when(~inside, F.coalesce("bucket", F.lit("uncovered"))).alias("classification"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(node, n): edges that end in each node."""
    return edges.where("dst is not null").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))


def blast_radius(members: DataFrame, workflow_files: DataFrame, edges: DataFrame, total_files: DataFrame) -> DataFrame:
    """Per cluster: workflows touched, largest in-degree and the score
    min(1, touched / workflows + in-degree / files).

    members: cluster, file; workflow_files: workflow, file; total_files: file.
    """
    touched = members.join(workflow_files, "file").groupBy("cluster").agg(F.countDistinct("workflow").alias("touched"))
    degree = members.join(in_degree(edges).withColumnRenamed("node", "file"), "file").groupBy("cluster").agg(F.max("n").alias("max_in_degree"))
    totals = workflow_files.agg(F.greatest(F.lit(1), F.countDistinct("workflow")).alias("workflows")).crossJoin(total_files.agg(F.greatest(F.lit(1), F.countDistinct("file")).alias("files")))
    joined = members.select("cluster").distinct().join(touched, "cluster", "left").join(degree, "cluster", "left").crossJoin(F.broadcast(totals))
    share = F.coalesce("touched", F.lit(0)) / F.col("workflows")
    return joined.select(
        "cluster", F.coalesce("touched", F.lit(0)).alias("workflows_touched"), F.coalesce("max_in_degree", F.lit(0)).alias("max_in_degree"),
        F.round(F.least(F.lit(1.0), share + F.coalesce("max_in_degree", F.lit(0)) / F.col("files")), 3).alias("score"),
    )


def reverse_index(workflow_files: DataFrame) -> DataFrame:
    """file -> sorted workflows."""
    return workflow_files.groupBy("file").agg(F.array_sort(F.collect_set("workflow")).alias("workflows"))


def induced(edges: DataFrame, nodes: DataFrame, most: int = 30) -> DataFrame:
    """Edges with both ends among the first ``most`` nodes (by name): a feature
    of the diagram, not a shortcut."""
    kept = nodes.select("node").distinct().orderBy("node").limit(most)
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
