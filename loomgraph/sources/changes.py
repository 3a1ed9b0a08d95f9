"""Writes of files that take effect together and can be taken back.

A change is a relation (file, text) below a root; a null text removes a file.

1. tasks put the old and the new content of their files into the store, named by
   their SHA-256, and log (file, before, after). Nothing below the root changes;
2. the log is closed by a marker; from here on the change can be undone;
3. tasks move the new contents to their places. If any of them fails, all files
   get their old contents back, by the same log, and the change has failed.

All three can be repeated by another executor: contents are named by what they
hold, and a move replaces a file at once. :func:`recover` undoes changes whose
driver was lost between 2 and 3. Markers are only ever added.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import glob_regex
from . import store

LOG = "file string, before string, after string"
#: names that no change may touch
PROTECTED = (".git/**", "**/.git/**", ".env", "**/.env", ".env.*", "**/.env.*")


class UnsafePath(ValueError):
    """A change names files that lie outside the root or are protected."""


def is_unsafe(file: Column, protected: tuple[str, ...] = PROTECTED) -> Column:
    """Whether a name leaves the root, isn't a plain relative path or is protected."""
    steps = F.split(file, "/")
    odd = F.exists(steps, lambda s: s.isin("", ".", "..")) | file.rlike("[\\\\\\x00-\\x1F]") | file.rlike("^[A-Za-z]:")
    for glob in protected:
        odd = odd | file.rlike(glob_regex(glob))
    return F.coalesce(odd, F.lit(True))


def _stage(root: str, blobs: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store.opened(root)
        keep, under = store.opened(blobs)

        def kept(content: bytes | None) -> str | None:
            if content is None:
                return None
            name = hashlib.sha256(content).hexdigest()
            if store.read_bytes(keep, f"{under}/{name}") != content:
                store.place_bytes(keep, f"{under}/{name}", content)
            return name

        for b in batches:
            rows = [(file, kept(store.read_bytes(files, f"{base}/{file}")), kept(None if text is None else text.encode())) for file, text in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            file, before, after = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({"file": pa.array(file, pa.string()), "before": pa.array(before, pa.string()), "after": pa.array(after, pa.string())})

    return run


def _move(root: str, blobs: str) -> Callable:
    """Give each (file, sha) the content of that name; none removes the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store.opened(root)
        keep, under = store.opened(blobs)
        for b in batches:
            for file, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content = None if sha is None else store.read_bytes(keep, f"{under}/{sha}")
                there = store.read_bytes(files, f"{base}/{file}")
                if sha is not None and content is None:
                    raise FileNotFoundError(f"the store has no content {sha}")
                if content is None and there is not None:
                    files.delete_file(f"{base}/{file}")
                elif content is not None and there != content:
                    store.place_bytes(files, f"{base}/{file}", content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return run


class ChangeStore:
    """The changes of the files below ``root``, kept in ``folder``."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), folder.rstrip("/")

    def _mark(self, change: str, state: str, **more) -> None:
        store.replace_json(self.spark, f"{self.folder}/{change}/{state}.json", {"id": change, "state": state, "at": time.time(), **more})

    def log(self, change: str) -> DataFrame:
        """(file, before, after) of a change."""
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/{change}/log")

    def _put(self, change: str, which: str) -> int:
        moves = self.log(change).select("file", which).mapInArrow(_move(self.root, f"{self.folder}/blobs"), "n long")
        return moves.agg(F.sum("n")).first()[0] or 0

    def apply(self, files: DataFrame, origin: str, protected: tuple[str, ...] = PROTECTED) -> str:
        """Write (file, text) below the root; the change's id. Unsafe names and
        names given twice are errors before anything is written."""
        asked = files.select("file", "text")
        bad = asked.where(is_unsafe(F.col("file"), protected)).select("file").limit(5).collect()
        if bad:
            raise UnsafePath(f"no change to {sorted(str(r.file) for r in bad)}")
        twice = asked.groupBy("file").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"given twice: {sorted(r.file for r in twice)}")
        change = f"{time.time_ns():020}-{uuid.uuid4().hex[:6]}"
        asked.mapInArrow(_stage(self.root, f"{self.folder}/blobs"), LOG).write.parquet(f"{self.folder}/{change}/log")
        self._mark(change, "prepared", origin=origin)
        try:
            n = self._put(change, "after")
        except Exception:
            self._put(change, "before")
            self._mark(change, "failed", origin=origin)
            raise
        self._mark(change, "done", origin=origin, files=n)
        return change

    def rollback(self, change: str) -> None:
        """Give the files of a change back what they held before it."""
        state = self.state(change)
        if state != "done":
            raise ValueError(f"change {change} is {state}")
        self._put(change, "before")
        self._mark(change, "rolled-back")

    def recover(self) -> list[str]:
        """Undo changes that were prepared and neither done nor undone."""
        open_ones = [c for c in self.ids() if self.state(c) == "prepared"]
        for change in open_ones:
            self._put(change, "before")
            self._mark(change, "failed")
        return open_ones

    def ids(self) -> list[str]:
        """All changes that were prepared, the first one first."""
        return [c for c in store.names(self.spark, self.folder) if c != "blobs" and store.exists(self.spark, f"{self.folder}/{c}/prepared.json")]

    def state(self, change: str) -> str:
        """prepared, done, failed, rolled-back; unknown for other ids."""
        at = lambda state: store.exists(self.spark, f"{self.folder}/{change}/{state}.json")
        return next((s for s in ("rolled-back", "failed", "done", "prepared") if at(s)), "unknown")
