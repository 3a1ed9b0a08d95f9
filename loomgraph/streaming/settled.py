"""Changes of files that have come to rest, by keyed state.

The state of a file is a value: what was last reported (a hash), and the change
that waits. A change waits until ``quiet`` seconds of event time have passed
without another one of the file (a timer), and is reported then if its content
differs from what was reported before. A batch reads and writes the state of
the files it touches, and of those whose timers are due; nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "file string, change string, text string, at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kind(was: str | None, now: str | None) -> str | None:
    """What a change from one hash to another is; None if it is none."""
    if was == now:
        return None
    return "added" if was is None else "removed" if now is None else "changed"


class Settle(StatefulProcessor):
    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reported = handle.getValueState("reported", "sha string")
        self.waiting = handle.getValueState("waiting", "text string, at long")

    def _report(self, file: str, text: str | None, at: int) -> list[tuple]:
        was = self.reported.get()[0] if self.reported.exists() else None
        now = None if text is None else hashlib.sha1(text.encode()).hexdigest()
        change = kind(was, now)
        if now is None:
            self.reported.clear()
        elif change:
            self.reported.update((now,))
        return [(file, change, text, pd.Timestamp(at, unit="us"))] if change else []

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["file", "change", "text", "at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        file, out = key[0], []
        found = sorted(((int(r.us), r.text is not None, r.text) for part in rows for r in part.itertuples()), key=lambda r: (r[0], r[1], r[2] or ""))
        held = self.waiting.get() if self.waiting.exists() else None
        if held is not None:
            self.handle.deleteTimer(held[1] // 1000 + self.quiet)
        for at, _, text in found:
            if held is not None and at < held[1]:
                continue  # it came later than what followed it
            if held is not None and at - held[1] >= self.quiet * 1000:
                out += self._report(file, *held)
            held = (text, at)
        self.waiting.update(held)
        self.handle.registerTimer(held[1] // 1000 + self.quiet)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        held = self.waiting.get()
        self.waiting.clear()
        yield from self._frame(self._report(key[0], *held))

    def close(self) -> None:
        pass


def settled(changes: DataFrame, quiet: float, late: str = "0 seconds") -> DataFrame:
    """A stream of (file, change, text, at) from a stream of (file, text, at); a
    null text is a removal. Of changes at one time, a text wins over a removal
    and a later text in order over an earlier one. Needs the RocksDB state store
    (``PROVIDER``)."""
    rows = changes.select("file", "text", F.col("at").cast("timestamp").alias("at")).where("file is not null and at is not null")
    rows = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("file").transformWithStateInPandas(statefulProcessor=Settle(int(quiet * 1000)), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def settled_batch(changes: DataFrame, quiet: float) -> DataFrame:
    """The same of a whole table, changes that still wait at its end among them."""
    rows = changes.select("file", "text", F.col("at").cast("timestamp").alias("at")).where("file is not null and at is not null")
    order = Window.partitionBy("file").orderBy("at", F.col("text").isNotNull(), "text")
    gap = F.unix_micros(F.lead("at").over(order)) - F.unix_micros("at")
    last = rows.withColumn("gap", gap).where(f"gap is null or gap >= {int(quiet * 1000) * 1000}")
    sha = F.sha1("text")
    was = F.lag(sha).over(order)
    change = F.when(was.isNull(), "added").when(sha.isNull(), "removed").otherwise("changed")
    return last.withColumns({"change": change, "same": was.eqNullSafe(sha)}).where("not same").select("file", "change", "text", "at")
