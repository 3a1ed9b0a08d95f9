"""A tree of files as a stream of changes.

``spark.readStream.format("tree_changes")`` lists a tree at every trigger. An
offset is the number of a listing kept in the folder ``listings``; what lies
between two offsets is the difference of their listings, so a batch that runs
again, or a stream that begins again from its checkpoint, gives the same files.
The driver lists names; tasks read the texts, a partition for a number of files.

Options: path; listings (a folder that outlives the stream, one for each
stream); files (names' ends, comma-separated, none for all); ignore (names of
folders left out); chunk (files a partition).

A row is (file, text, change, at): added, changed or removed, a null text where
the file is gone, ``at`` its time of modification or, if gone, of the listing.
Bytes that aren't UTF-8 are replaced. A file that goes between listing and
reading gives no row then; the next listing reports it as removed. An edit that
keeps both size and time of modification can't be seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import store
from ..sources.project import IGNORED

SCHEMA = "file string, text string, change string, at timestamp"


@dataclass
class Files(InputPartition):
    """Files to read: (name, change, nanoseconds of ``at``)."""

    files: list[tuple[str, str, int]]


def listing(root: str, ends: tuple[str, ...], ignore: tuple[str, ...]) -> dict[str, list[int]]:
    """Size and time of modification of a tree's files."""
    from pyarrow import fs

    files, base = store.opened(root)
    out: dict[str, list[int]] = {}
    for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = info.path[len(base.rstrip("/")) + 1 :]
        if info.type == fs.FileType.File and name.endswith(ends) and not name.endswith(".tmp") and not set(name.split("/")[:-1]) & set(ignore):
            out[name] = [info.size, info.mtime_ns]
    return out


def between(old: dict[str, list[int]], new: dict[str, list[int]], now: int) -> list[tuple[str, str, int]]:
    """What changed from one listing to another, by name."""
    gone = [(name, "removed", now) for name in old if name not in new]
    come = [(name, "changed" if name in old else "added", at[1]) for name, at in new.items() if old.get(name) != at]
    return sorted(gone + come)


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.kept = options["path"], options["listings"]
        self.ends = tuple(x for x in options.get("files", "").split(",") if x) or ("",)
        self.ignore = tuple(x for x in options["ignore"].split(",") if x) if "ignore" in options else IGNORED
        self.chunk = int(options.get("chunk", "64"))

    def _names(self) -> list[int]:
        from pyarrow import fs

        files, base = store.opened(self.kept)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json"))

    def _listing(self, n: int) -> dict:
        files, base = store.opened(self.kept)
        raw = store.read_bytes(files, f"{base}/{n}.json") if n else b'{"files": {}, "at": 0}'
        if raw is None:
            raise FileNotFoundError(f"listing {n} is missing from {self.kept}")
        return json.loads(raw)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The newest listing, a new one where the tree has changed since."""
        last = max(self._names(), default=0)
        now = listing(self.root, self.ends, self.ignore)
        if now != self._listing(last)["files"]:
            files, base = store.opened(self.kept)
            last += 1
            at = int(datetime.now(timezone.utc).timestamp() * 1e9)
            store.place_bytes(files, f"{base}/{last}.json", json.dumps({"files": now, "at": at}).encode())
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = self._listing(end["listing"])
        rows = between(self._listing(start["listing"])["files"], new["files"], new["at"])
        return [Files(rows[k : k + self.chunk]) for k in range(0, len(rows), self.chunk)]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, base = store.opened(self.root)
        for name, change, ns in partition.files:
            at = datetime.fromtimestamp(ns / 1e9, timezone.utc)
            content = None if change == "removed" else store.read_bytes(files, f"{base}/{name}")
            if change == "removed" or content is not None:
                yield name, None if content is None else content.decode("utf-8", "replace"), change, at

    def commit(self, end: dict) -> None:
        """Listings before the one that a batch ended with aren't read again."""
        files, base = store.opened(self.kept)
        for n in self._names():
            if n < end["listing"]:
                files.delete_file(f"{base}/{n}.json")


class TreeChanges(DataSource):
    """The format ``tree_changes``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def tree_changes(spark: SparkSession, path: str, listings: str, files: str = "", chunk: int = 64):
    """A streaming DataFrame of the changes below ``path``."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", path).option("listings", listings).option("files", files).option("chunk", chunk).load()
