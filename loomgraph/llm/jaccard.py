"""N-gram Jaccard join by an LSH forest of MinHash signatures.

A document is its set of runs of five words (A-Z as a-z; fewer than five words
are one run). Documents with equal sets are one class member with a
multiplicity. Every set gets a signature of TREES * DEPTH minima; DEPTH of them
are its label in a tree.

A tree is a sorted run of labels: neighbours that share a prefix are a node of
its trie. Matching begins with the longest prefix, DEPTH minima, and shortens it
minimum by minimum. At each length only those members of a node are compared
that longer prefixes haven't joined to one cell yet, so a crowd of near copies
is settled by the first prefix that they share, while looser neighbours are
found at a shorter one. Shortening ends where the expected recall of a link at
the threshold, 1 - (1 - t**length)**TREES, has reached the target (4 minima at
0.8). The subtrees below that length are what is shuffled: a task holds whole
subtrees and builds their runs by sorting.

Comparisons are by signature, at a similarity so far below the threshold that
a link passes but for odds of about 1 in 10**5; they link documents into cells
(connected components). The documents of a cell are then compared with each
other exactly, on their whole sets of 64-bit shingle hashes; large subtrees and
cells are dealt out as pairs of blocks, so no task holds an unbounded group.
Only counts and a spanning forest leave a block, never all pairs.

Defined results: null, empty and wordless texts link with nothing and are
classes of their own; repeated rows are separate documents that link; a null
doc_id takes part, and the class is the smallest non-null id in it; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, spanning
from ..session import cut, discard
from .grouped import SMALL, block_pairs, fixed, map_arrow, map_groups, small_pairs
from .text import U, chunks, mix, shingles, strings, word_hashes

TREES, DEPTH, RECALL, BLOCK, LOOSE = 16, 8, 0.999, 512, 0.17
_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_ODD = _SEEDS | U(1)


def depth_for(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix whose expected recall at the threshold is enough."""
    return next((d for d in range(DEPTH, 1, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = strings(column)
    for a, z in chunks(off):
        hashes, first = word_hashes(data[off[a] : off[z]], off[a : z + 1] - off[a])
        terms, begin = shingles(hashes, first, size)
        for k in range(z - a):
            yield np.unique(terms[begin[k] : begin[k + 1]])


def signature(terms: np.ndarray) -> np.ndarray:
    """The upper half of the minimum of each hash function over a set."""
    out = np.full(len(_ODD), ~U(0))
    for k in range(0, len(terms), 1024):
        out = np.minimum(out, (terms[k : k + 1024, None] * _ODD + _SEEDS).min(axis=0))
    return (out >> U(32)).astype(np.uint32)


def set_hash(terms: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([mix(terms).sum(dtype=U), mix(terms ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)]).tobytes()


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """key (of the row's text and id), doc_id, set, sig for each row."""
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, sigs = [], []
            for terms in shingle_sets(b.column(2), size):
                sets.append(set_hash(terms) if len(terms) else None)
                sigs.append(signature(terms).tobytes() if len(terms) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "set", "sig"])

    return rows.transform(map_arrow, run, "doc_id long, text_hash long, set binary, sig binary")


def forest_links(labels: np.ndarray, sig: np.ndarray, bounds: np.ndarray, least: float, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, length): rows joined to cells, and the prefix that joined them.

    labels: rows of minima, sorted inside each run that ``bounds`` delimits.
    ``least``: how many minima of two signatures must agree.
    """
    n, depth = labels.shape
    shared = np.zeros(n, np.int64)  # the prefix that a row shares with the row above
    shared[1:] = np.cumprod(labels[1:] == labels[:-1], axis=1).sum(axis=1)
    shared[bounds[:-1]] = -1
    cell, own = np.arange(n), np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for length in range(depth, floor - 1, -1):
        edge = np.flatnonzero(np.append(shared < length, True))
        below = np.cumsum(shared <= length) if length < depth else own  # the child of a longer prefix
        left, right = [], []
        a, b = small_pairs(edge)
        for lo in range(0, len(a), 20_000):
            p, q = a[lo : lo + 20_000], b[lo : lo + 20_000]
            new = (cell[p] != cell[q]) & (below[p] != below[q])
            p, q = p[new], q[new]
            near = (sig[p] == sig[q]).sum(axis=1) >= least
            left.append(p[near])
            right.append(q[near])
        sizes = np.diff(edge)
        for lo, size in zip(edge[:-1][sizes > SMALL], sizes[sizes > SMALL], strict=True):
            here, cells, child = sig[lo : lo + size], cell[lo : lo + size].copy(), below[lo : lo + size]
            for k in range(size):
                others = k + np.flatnonzero((cells[k:] != cells[k]) & (child[k:] != child[k]))
                if len(others):
                    near = others[(here[others] == here[k]).sum(axis=1) >= least]
                    if len(near):
                        left.append(np.full(len(near), lo + k))
                        right.append(lo + near)
                        cells[np.isin(cells, cells[near])] = cells[k]
                elif (cells == cells[0]).all():
                    break
        x, y = np.concatenate(left or [a[:0]]), np.concatenate(right or [a[:0]])
        if len(x):
            found.append((x, y, np.full(len(x), length)))
            cell = spanning(n, np.concatenate([own, x]), np.concatenate([cell, y]))
    if not found:
        return own[:0], own[:0], own[:0]
    x, y, length = (np.concatenate(part) for part in zip(*found, strict=True))
    return x, y, length


def _near_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """(src, dst): edges that span the likely links of every subtree."""
    floor, least = depth_for(threshold), (threshold - LOOSE) * TREES * DEPTH
    wide = 4 * DEPTH
    parts = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 1 + wide * t, 4 * floor)) for t in range(TREES)])
    nodes = reps.select("rep", F.posexplode(parts).alias("tree", "prefix"))
    shape = nodes.groupBy("tree", "prefix").agg(
        F.count("*").alias("n"), F.min("rep").alias("low"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"),
    ).where("n > 1")
    #: subtrees with the same members are compared once
    once = shape.groupBy("n", "low", "sum").agg(F.min(F.struct("tree", "prefix")).alias("node")).select("node.*", "n")
    members = nodes.join(once, ["tree", "prefix"])
    dealt = block_pairs(members, "n", "rep", BLOCK).join(reps.select("rep", "sig"), "rep").withColumn("label", F.expr(f"substring(sig, 1 + {wide} * tree, {wide})"))

    def link(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        sig, labels, rep = fixed(t["sig"], np.uint32, n), fixed(t["label"], np.uint32, n), t["rep"].to_numpy()
        a, b, _ = forest_links(labels, sig, bounds, least, floor)
        root = spanning(n, a, b)
        some = root != np.arange(n)
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]])], names=["src", "dst"])

    return map_groups(dealt, ["tree", "prefix", "cell_a", "cell_b"], "label", ["rep", "sig"], link, "src long, dst long")


def exact_links(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs x < y with Jaccard >= threshold."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n <= 6:
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        x, y = np.array(pairs, np.int64).reshape(-1, 2).T
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    else:
        terms, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        count = np.bincount(inverse, minlength=len(terms))
        owner = np.repeat(np.arange(n), sizes)
        everywhere = int((count == n).sum())
        #: shingles of one document add nothing to an intersection, those of all add one
        keep = (count[inverse] > 1) & (count[inverse] < n)
        cols, owner = (np.cumsum((count > 1) & (count < n)) - 1)[inverse[keep]], owner[keep]
        order = np.argsort(cols, kind="stable")
        cols, owner = cols[order], owner[order]
        common, width = np.full((n, n), everywhere, np.int64), 2048
        for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
            a, z = np.searchsorted(cols, [lo, lo + width])
            dense = np.zeros((n, width), np.float32)
            dense[owner[a:z], cols[a:z] - lo] = 1
            common += (dense @ dense.T).astype(np.int64)  # below 2**24, so exact
        x, y = np.nonzero(np.triu(common, 1))
        both = common[x, y]
    near = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
    return x[near], y[near]


def jaccard_join(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, class_key for every row of docs.

    n_links: other rows at the threshold or above. class_id: the smallest
    doc_id that links reach. class_key: equal for the rows of a class, whatever
    their ids; null for a text without words, which is alone.
    """
    docs = docs.select("doc_id", "text")
    signed = cut(_signed(docs, words), "jaccard-sig")
    reps = cut(
        signed.where("set is not null").groupBy("set").agg(
            F.first("sig").alias("sig"), F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(-1)), "text_hash")).alias("one"),
        ).select(F.xxhash64("set").alias("rep"), "set", "sig", "copies", "doc_id", F.col("one.text_hash").alias("one_hash"), F.expr("one.col1").alias("one_id")),
        "jaccard-rep",
    )
    keys, near = cut(signed.drop("sig"), "jaccard-key"), cut(_near_edges(reps, threshold), "jaccard-near")
    slim = cut(reps.drop("sig"), "jaccard-slim")
    for wide in (signed, reps):  # signatures are the bulk, and done with
        discard(wide)
    cells = connected_components(near).withColumnRenamed("node", "rep")
    sized = cells.join(cells.groupBy("component").agg(F.count("*").alias("n")), "component")
    chosen = cut(sized.join(slim.select("rep", "copies", "one_id", "one_hash"), "rep"), "jaccard-cell")
    #: one row of text for each member of a cell
    texts = (
        docs.select(F.coalesce("doc_id", F.lit(-1)).alias("one_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("one_hash"), "text")
        .join(chosen.hint("merge"), ["one_id", "one_hash"]).dropDuplicates(["rep"])
    )
    dealt = block_pairs(texts.select("component", "n", "rep", "copies", "text"), "n", "rep", BLOCK)

    def verify(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        rep, copies, mine, cell_a, cell_b = (t[c].to_numpy() for c in ("rep", "copies", "mine", "cell_a", "cell_b"))
        links, left, right = np.zeros(n, np.int64), [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            sets = list(shingle_sets(t["text"].slice(lo, hi - lo), words))
            p, q = exact_links(sets, threshold)
            p, q = p + lo, q + lo
            fits = ((mine[p] == cell_a[p]) & (mine[q] == cell_b[p])) | ((mine[q] == cell_a[p]) & (mine[p] == cell_b[p]))
            p, q = p[fits], q[fits]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            left.append(p)
            right.append(q)
        root = spanning(n, np.concatenate(left), np.concatenate(right))
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(rep[root])], names=["rep", "links", "root"])

    verified = cut(
        map_groups(dealt, ["component", "cell_a", "cell_b"], "rep", ["mine", "copies", "text"], verify, "rep long, links long, root long"),
        "jaccard-link",
    )
    groups = connected_components(verified, "rep", "root").withColumnRenamed("node", "rep")
    linked = groups.join(verified.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
    full = slim.select("rep", "set", "copies", "doc_id").join(linked, "rep", "left").select(
        "set", "doc_id", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = full.join(full.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("set", "class_id", "n_links", F.col("component").alias("class_key"))
    return keys.select("doc_id", "text_hash", "set").join(named, "set", "left").select(
        "doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_key",
    )
