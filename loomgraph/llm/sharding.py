"""Sharding by global byte-size prefix sums. DataFrame functions only.

Rows are laid out along one global order, (hash of the text, doc_id), so equal
texts lie side by side. Each range partition reports its total; running totals
of those give every partition its offset, and offset plus running sum inside
the partition gives every row its place in the byte stream. Cutting the stream
at equal targets gives contiguous shards of near equal size.

A cut that falls inside a run of equal texts moves to the nearer edge of the
run when that moves it by at most ``slack`` of a target; otherwise the run,
however large, is cut between rows. So small groups of copies stay together
and a large one can't unbalance the shards.

Defined results: a null text has size 1 and the checksum of the empty text;
repeated rows and null ids are rows like any other; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def shard_by_bytes(docs: DataFrame, shards: int = 8, slack: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for all rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    placed = cut(rows.repartitionByRange("h", "doc_id").withColumn("part", F.spark_partition_id()), "shard")
    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_base"),
    )
    within = Window.partitionBy("part").orderBy("h", "doc_id", "text_crc32")
    stream = placed.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", "h",
        (F.col("byte_base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        (F.col("row_base") + F.row_number().over(within) - 1).alias("row"),
    )
    stream = cut(stream, "shard-stream")
    cuts = _cuts(stream, shards, slack)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("at") >= F.lit(c)).cast("int")
    dealt = stream.withColumn("shard", shard)
    first = dealt.groupBy("shard").agg(F.min("row").alias("first_row"))
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(stream: DataFrame, shards: int, slack: float) -> list[int]:
    """The shards - 1 places where a new shard begins: so many numbers, no rows."""
    total = stream.agg(F.sum("size")).first()[0]
    if not total or shards < 2:
        return []
    targets = [-(-total * k // shards) for k in range(1, shards)]
    #: the row that each target falls into
    hit = F.lit(None).cast("int")
    for k, t in enumerate(targets):
        hit = F.when((F.col("at") < t) & (F.col("at") + F.col("size") >= t), F.lit(k)).otherwise(hit)
    inside = F.array_compact(F.array(*[
        F.when((F.col("at") < t) & (F.col("at") + F.col("size") >= t), F.lit(k)) for k, t in enumerate(targets)
    ]))
    cells = {
        k: r for r in stream.where(hit.isNotNull()).select("h", "at", "size", inside.alias("ks")).collect() for k in r.ks
    }
    runs = {
        r.h: (r.begin, r.end)
        for r in stream.where(F.col("h").isin(sorted({c.h for c in cells.values()})))
        .groupBy("h").agg(F.min("at").alias("begin"), F.max(F.col("at") + F.col("size")).alias("end")).collect()
    }
    out, low = [], 0
    for k, t in enumerate(targets):
        c = cells[k]
        near = min(runs[c.h], key=lambda x: (abs(x - t), x))
        if abs(near - t) > slack * total / shards:
            near = min((c.at, c.at + c.size), key=lambda x: (abs(x - t), x))
        low = max(low, near)
        out.append(low)
    return out
