"""SimHash fingerprints: weighted term hashes vote on signed bits.

Terms are the runs of two words (a lone word is its own term) with their counts
as weights; a term's hash votes with its weight for or against every bit, and
the sign of the sum is the bit. Fingerprints have 128 bits, as 32 hex digits.
Their likeness is the cosine that the share of differing bits estimates,
cos(pi * d / 128), and 0 from half of the bits on.

``within_radius`` finds all fingerprints within a Hamming radius by permuted
block tables: with radius + 1 blocks, two fingerprints within the radius agree
on one block at least, so each table brings one block to the front and
fingerprints meet under it and are verified. Equal fingerprints are one entry, never
expanded.

Defined results: null and empty texts, and texts without words, have the
fingerprint 0; an empty table gives an empty result; repeated rows are rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .grouped import SMALL, block_pairs, fixed, map_groups, small_pairs
from .text import U, chunks, mix, shingles, strings, word_hashes

BITS, RADIUS, BLOCK = 128, 3, 1024
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1)
_POP = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


def fingerprints(column: pa.Array, term_words: int = 2) -> np.ndarray:
    """(rows, 16) bytes: a fingerprint for each text of an Arrow column."""
    data, off = strings(column)
    out = np.zeros((len(off) - 1, BITS // 8), np.uint8)
    for a, z in chunks(off):
        hashes, first = word_hashes(data[off[a] : off[z]], off[a : z + 1] - off[a])
        terms, begin = shingles(hashes, first, term_words)
        wide = np.stack([terms, mix(terms + U(1))], axis=1).view(np.uint8)
        for k in range(z - a):
            rows = wide[begin[k] : begin[k + 1]]
            if len(rows):
                votes = np.concatenate([np.bincount(rows[:, j], minlength=256) @ _SIGNS for j in range(BITS // 8)])
                out[a + k] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints."""
    differ = _POP[a ^ b].sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * differ / BITS))


def fingerprint_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the fingerprint of every text."""
    names = [*keep, "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([x.tobytes().hex() for x in fingerprints(b.column(len(names) - 1))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], prints], names=[*keep, "fingerprint"])

    return docs.select(*names).mapInArrow(run, schema)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _digests(ids: list, texts: list[str], final: str) -> pa.RecordBatch:
    """Rows in order; ``final`` is the text after the last."""
    nexts = [*texts[1:], final]
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, nexts, halves, strict=True)]
    own, after = (fingerprints(pa.array(x, pa.large_string())) for x in ([*texts, final], edited))
    own, other = own[:-1], own[1:]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([x.tobytes().hex() for x in own], pa.string()), pa.array([x.tobytes().hex() for x in after], pa.string()),
        pa.array(likeness(own, after)), pa.array(likeness(own, other)),
    ], names=[c.split()[0] for c in _OUT.split(", ")])


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the registry).

    Rows are range-partitioned by descending doc_id once. A partition streams
    through its rows with one row of look-ahead; only its last row needs the
    head of the next partition, so heads and last rows (two for each
    partition) are set aside and meet in a join.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(parts, F.col("doc_id").desc_nulls_last(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "tie").withColumn("part", F.spark_partition_id())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edge(kind: str, row: tuple) -> pa.RecordBatch:
            out = {f.split()[0]: None for f in _OUT.split(", ")} | {"doc_id": row[0], "kind": kind, "part": row[2], "text": row[1]}
            return pa.RecordBatch.from_pylist([out], schema=schema)

        held = None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                few = b.slice(lo, 256)
                rows = list(zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(3).to_pylist(), strict=True))
                if held is None:
                    yield edge("head", rows[0])
                else:
                    rows.insert(0, held)
                held = rows[-1]
                if len(rows) > 1:
                    made = _digests([r[0] for r in rows[:-1]], [r[1] for r in rows[:-1]], held[1])
                    n = made.num_rows
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(["row"] * n), pa.array([held[2]] * n, pa.int32()), pa.nulls(n, pa.string())], schema=schema)
        if held is not None:
            yield edge("last", held)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    full = _OUT + ", kind string, part int, text string"
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in full.split(", ")])
    made = cut(dealt.mapInArrow(run, full), "simhash")
    names = [c.split()[0] for c in _OUT.split(", ")]
    #: partitions that have rows, in order; the first follows the last
    order = [r.part for r in made.where("kind = 'head'").select("part").orderBy("part").collect()]
    if not order:
        return made.select(*names)
    after = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, next_part int")
    heads = made.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = made.where("kind = 'last'").select("part", "doc_id", "text").join(after, "part").join(heads, "next_part")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc_id, text, following in zip(f.doc_id, f.text, f.next_text, strict=True):
                yield _digests([None if pd.isna(doc_id) else int(doc_id)], [text], following).to_pandas()

    closing = cut(lasts.select("doc_id", "text", "next_text").mapInPandas(finish, _OUT), "simhash-last")
    return made.where("kind = 'row'").select(*names).unionByName(closing)


def with_near(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """found with n_near: other distinct fingerprints within the radius of the
    row's own; found is read twice."""
    near = within_radius(found, radius)
    return found.join(near, "fingerprint", "left").select(*found.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, n_near: how many other fingerprints are at most ``radius``
    bits apart, for every distinct fingerprint that has any.

    prints: a column ``fingerprint``. Rows with equal fingerprints are one. A
    table for each of radius + 1 blocks brings its block to the front; the
    fingerprints that agree there are compared, those of a large group as pairs
    of blocks. A pair is counted in the first table that it shares, so nothing
    but counts leaves a group.
    """
    tables = radius + 1
    edges = np.array([BITS * k // tables for k in range(tables + 1)])
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(BITS // 32)])
    one = prints.select("fingerprint").where("fingerprint is not null").distinct()
    values = F.array(*[F.xxhash64(F.lit(k), F.substring(bits, int(a) + 1, int(z - a))) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))])
    placed = cut(one.select(F.unhex("fingerprint").alias("print"), F.xxhash64("fingerprint").alias("rep"), F.posexplode(values).alias("tab", "value")), "simhash-tables")
    sizes = placed.groupBy("tab", "value").agg(F.count("*").alias("n")).where("n > 1")
    dealt = block_pairs(placed.join(sizes, ["tab", "value"]), "n", "rep", BLOCK)

    def compare(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw = fixed(t["print"], np.uint8, t.num_rows)
        mine, cell_a, cell_b, tab = (t[c].to_numpy() for c in ("mine", "cell_a", "cell_b", "tab"))
        near = np.zeros(t.num_rows, np.int64)

        def count(p: np.ndarray, q: np.ndarray) -> None:
            fits = ((mine[p] == cell_a[p]) & (mine[q] == cell_b[p])) | ((mine[q] == cell_a[p]) & (mine[p] == cell_b[p]))
            p, q = p[fits], q[fits]
            close = _POP[raw[p] ^ raw[q]].sum(axis=1) <= radius
            p, q = p[close], q[close]
            if len(p):
                apart = np.unpackbits(raw[p] ^ raw[q], axis=1)
                differ = np.stack([apart[:, a:z].any(axis=1) for a, z in zip(edges, edges[1:], strict=False)], axis=1)
                first = (~differ).argmax(axis=1) == tab[p]
                near[:] += np.bincount(p[first], minlength=len(near)) + np.bincount(q[first], minlength=len(near))

        a, b = small_pairs(bounds)
        for lo in range(0, len(a), 50_000):
            count(a[lo : lo + 50_000], b[lo : lo + 50_000])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            for k in range(lo, hi) if hi - lo > SMALL else ():
                others = np.arange(k + 1, hi)
                count(np.full(len(others), k), others)
        some = near > 0
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes().hex() for x in raw[some]], pa.string()), pa.array(near[some])], names=["fingerprint", "n"])

    counted = map_groups(dealt, ["tab", "value", "cell_a", "cell_b"], "rep", ["mine", "print"], compare, "fingerprint string, n long")
    return counted.groupBy("fingerprint").agg(F.sum("n").alias("n_near"))
