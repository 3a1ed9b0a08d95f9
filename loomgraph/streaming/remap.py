"""Incremental re-mapping and event sessions as Structured Streaming.

Changes arrive as rows (file, text, at). Each micro-batch keeps the last change
of each file, merges it into the state table and hands the difference to a
callback; a failing batch is reported and the stream goes on. State tables are
versions in a folder: a batch that runs again writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "file string, text string, at timestamp"


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The files after changes; a null text is a removal, the latest row wins."""
    w = Window.partitionBy("file").orderBy(F.col("at").desc(), F.col("origin").desc())
    both = state.withColumn("origin", F.lit(0)).unionByName(changes.select("file", "text", "at").withColumn("origin", F.lit(1)))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1 and text is not null").select("file", "text", "at")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change) between two states: added, removed or changed."""
    a = before.select("file", F.sha1("text").alias("was"))
    b = after.select("file", F.sha1("text").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return a.join(b, "file", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("file", change.alias("change"))


def watch(changes: DataFrame, state_path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None], on_error: Callable[[Exception, int], None] | None = None):
    """A streaming query over changes; returns the writer, ready to start.

    Batch n writes version n of the state from version n - 1; a version that is
    missing is an error, never an empty state. The last two versions stay, so a
    batch can be repeated. With ``on_error`` neither a batch that can't be merged
    nor a failing callback stops the watch; the former leaves the state as it was.
    """
    spark = changes.sparkSession
    jvm = spark.sparkContext._jvm

    def place(n: int):
        at = jvm.org.apache.hadoop.fs.Path(f"{state_path}/v{n}")
        return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(n: int) -> DataFrame:
        if n < 0:
            return spark.createDataFrame([], STATE)
        at, store = place(n)
        if not store.exists(at):
            raise FileNotFoundError(f"version {n} of the state is missing from {state_path}")
        return spark.read.schema(STATE).parquet(f"{state_path}/v{n}")

    def batch(df: DataFrame, n: int) -> None:
        before = version(n - 1)
        write = lambda rows: rows.write.mode("overwrite").parquet(f"{state_path}/v{n}")
        try:
            write(merge(before, df))
        except Exception as e:  # noqa: BLE001
            if on_error is None:
                raise
            write(before)
            on_error(e, n)
            return
        try:
            on_change(difference(before, version(n)), n)
        except Exception as e:  # noqa: BLE001  a bad callback doesn't stop the watch
            if on_error is None:
                raise
            on_error(e, n)
        if n > 1:
            at, store = place(n - 2)
            store.delete(at, True)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def by_severity(findings: DataFrame) -> dict[str, DataFrame]:
    """Outputs of an event's findings: regression for high ones, resolved for
    those that are gone, finding for the rest. New workflows are findings."""
    high, done = F.col("severity") == "high", F.col("status") == "resolved"
    return {"resolved": findings.where(done), "regression": findings.where(high & ~done), "finding": findings.where(~high & ~done)}


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user's events, with late rows dropped after ``late``."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by event type and tumbling window."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy("event_type", F.window("ts", size).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
