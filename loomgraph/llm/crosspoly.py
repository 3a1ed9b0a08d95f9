"""Embedding near-duplicates by cross-polytope hashing.

A rotation is three rounds of random signs and a fast Hadamard transform; a
unit vector hashes to the signed axis nearest to it after the rotation. A table
joins two rotations. Multiprobe: a vector enters its own bucket and the two
next in which one rotation gives its second nearest axis. Vectors that meet in
a bucket are compared by cosine in double precision; a pair is counted in the
first table and bucket that it shares, so counts need no list of pairs, and a
spanning forest of its links leaves each block.

Equal vectors of a label are one entry with a multiplicity. Buckets larger
than a block are dealt out as pairs of blocks, all of them: nothing is capped.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of
different lengths don't link; repeated rows link as others do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components, spanning
from ..session import cut
from .grouped import SMALL, block_pairs, map_groups, small_pairs

TABLES, SEED, BLOCK = 6, 23, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def probes(x: np.ndarray, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 3) bucket codes of unit vectors: own, then two probes."""
    n, dim = x.shape
    width = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, width])
    near = np.empty((n, tables, 2, 2), np.int64)
    for t in range(tables):
        for r in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            two = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            near[:, t, r] = 2 * two + (np.take_along_axis(y, two, axis=1) < 0)
    wide = 2 * width
    first, second = near[:, :, :, 0], near[:, :, :, 1]
    own = first[:, :, 0] * wide + first[:, :, 1]
    return np.stack([own, second[:, :, 0] * wide + first[:, :, 1], first[:, :, 0] * wide + second[:, :, 1]], axis=2)


def _usable() -> F.Column:
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(reps: DataFrame, tables: int, width: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            codes: list = [None] * len(vectors)
            unit: list = [None] * len(vectors)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.array([vectors[k] for k in at], width)
                for k, v, c in zip(at, x, probes(_unit(x), tables).reshape(len(at), -1), strict=True):
                    unit[k], codes[k] = v.tobytes(), c.astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(unit, pa.binary()), pa.array(codes, pa.list_(pa.int32())), b.column(3)], names=["rep", "lab", "dim", "vec", "codes", "copies"])

    e = F.col("embedding").cast("array<double>")
    return reps.select("rep", F.xxhash64("label").alias("lab"), e.alias("embedding"), "copies").mapInArrow(run, "rep long, lab long, dim int, vec binary, codes array<int>, copies long")


def near_vectors(vectors: DataFrame, least: float = 0.93, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    keyed = vectors.select("vec_id", "label", "embedding")
    good = keyed.where(_usable()).withColumn("same", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("string")), 256))
    good = cut(good, "cp-rows")
    reps = good.groupBy("same").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("rep", F.xxhash64("same"))
    #: vectors move as they are stored, and are scaled where they are compared
    width = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    hashed = cut(_hashed(reps, tables, width), "cp-codes")
    names = reps.select("same", "rep", "low", "copies")

    placed = hashed.select("rep", "lab", "dim", F.posexplode(F.expr("codes")).alias("slot", "code")).withColumn("tab", F.floor(F.col("slot") / 3).cast("int")).drop("slot")
    keys = ["lab", "dim", "tab", "code"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    dealt = block_pairs(placed.join(sizes, keys), "n", "rep", BLOCK).join(hashed.select("rep", "vec", "codes", "copies"), "rep")

    def compare(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        rep, copies, mine, cell_a, cell_b, tab, code, dim = (t[c].to_numpy() for c in ("rep", "copies", "mine", "cell_a", "cell_b", "tab", "code", "dim"))
        codes = t["codes"].combine_chunks().flatten().to_numpy().reshape(n, -1, 3)
        flat = np.frombuffer(b"".join(t["vec"].to_pylist()), width)
        begin = np.concatenate([[0], np.cumsum(dim)])
        links, left, right = np.zeros(n, np.int64), [], []

        def count(a: np.ndarray, b: np.ndarray) -> None:
            fits = ((mine[a] == cell_a[a]) & (mine[b] == cell_b[a])) | ((mine[b] == cell_a[a]) & (mine[a] == cell_b[a]))
            fits &= rep[a] != rep[b]
            a, b = a[fits], b[fits]
            left.append(a)
            right.append(b)
            for lo in range(0, len(a), 20_000):
                p, q = a[lo : lo + 20_000], b[lo : lo + 20_000]
                meet = codes[p][:, :, :, None] == codes[q][:, :, None, :]
                here = tab[p]
                earlier = (meet.any(axis=(2, 3)) & (np.arange(codes.shape[1]) < here[:, None])).any(axis=1)
                k = np.arange(len(p))
                shared = np.where(meet[k, here].any(axis=2), codes[p, here], np.iinfo(np.int32).max).min(axis=1)
                first = ~earlier & (shared == code[p])
                np.add.at(links, p[first], copies[q[first]])
                np.add.at(links, q[first], copies[p[first]])

        wide = dim[0]
        x = _unit(flat.reshape(n, wide)) if (dim == wide).all() else None
        vec = x.ravel() if x is not None else np.concatenate([_unit(flat[begin[k] : begin[k + 1]][None])[0] for k in range(n)])
        a, b = small_pairs(bounds)
        for lo in range(0, len(a), 50_000):
            p, q = a[lo : lo + 50_000], b[lo : lo + 50_000]
            if x is not None:
                near = np.einsum("ij,ij->i", x[p], x[q]) >= least
            else:
                near = np.array([vec[begin[i] : begin[i + 1]] @ vec[begin[j] : begin[j + 1]] >= least for i, j in zip(p, q, strict=True)], bool)
            count(p[near], q[near])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > SMALL:
                y = vec[begin[lo] : begin[hi]].reshape(hi - lo, -1)
                p, q = np.nonzero(np.triu(y @ y.T >= least, 1))
                count(p + lo, q + lo)
        root = spanning(n, np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int))
        some = (links > 0) | (root != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "root"])

    found = cut(
        map_groups(dealt, [*keys, "cell_a", "cell_b"], "rep", ["mine", "vec", "codes", "copies"], compare, "rep long, links long, root long"),
        "cp-links",
    )
    groups = connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    full = names.join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(groups, "rep", "left").select(
        "same", "low", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = full.join(full.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("same", "n_links", "component_id")
    linked = good.select("vec_id", "same").join(named, "same").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    bare = keyed.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(bare).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
