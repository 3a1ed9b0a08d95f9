"""Many globs against many paths in one pass.

Globs become one automaton: a tree of their tokens in which equal beginnings are
one path. A path is read once, with the set of places that its beginning can
stand at. The meaning is that of :func:`loomgraph.functions.paths.glob_regex`;
paths hold no line breaks. An automaton has BLOCK globs at most, which is what is
broadcast; more globs make more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 1 << 14
#: tokens beside single characters
ONE, SEGMENT, ANY, FOLDERS, BELOW = "?", "*", "**", "**/", "/**"


def tokens(glob: str) -> list[str]:
    """A glob's tokens: wildcards, the rest as pairs of a backslash and a character."""
    if glob.endswith("/**"):
        head = tokens(glob[:-3])
        return head if head[-1:] == [BELOW] else [*head, BELOW]
    out, at = [], 0
    while at < len(glob):
        token = next((w for w in (FOLDERS, ANY, SEGMENT, ONE) if glob.startswith(w, at)), None)
        out.append(token or "\\" + glob[at])
        at += len(token) if token else 1
    return out


class GlobSet:
    """The automaton of (id, glob) pairs."""

    def __init__(self, globs: list[tuple[object, str]]):
        #: by place: characters that lead on; wildcards that follow; whether it stays (segment, all); places a slash leads to as well
        self.steps: list[dict[str, int]] = [{}]
        self.one, self.stays, self.slash = [0], [""], [0]
        self.free: list[list[int]] = [[]]
        self.done: list[list] = [[]]
        self.below: list[list] = [[]]
        ways: dict[tuple[int, str], int] = {}
        for name, glob in globs:
            at = 0
            for token in tokens(glob):
                if token == BELOW:
                    break
                if (at, token) not in ways:
                    ways[at, token] = self._add(at, token)
                at = ways[at, token]
            (self.below if glob.endswith("/**") else self.done)[at].append(name)
        self.open: list[tuple[int, ...]] = [self._reach(k) for k in range(len(self.steps))]

    def _new(self, stays: str = "") -> int:
        for table, value in ((self.steps, {}), (self.one, 0), (self.stays, stays), (self.slash, 0), (self.free, []), (self.done, []), (self.below, [])):
            table.append(value)
        return len(self.steps) - 1

    def _add(self, at: int, token: str) -> int:
        """The place after a token."""
        if token[0] == "\\":
            self.steps[at][token[1]] = new = self._new()
        elif token == ONE:
            self.one[at] = new = self._new()
        elif token == FOLDERS:
            new, loop = self._new(), self._new("all")
            self.slash[loop] = new
            self.free[at] += [new, loop]
        else:
            new = self._new("all" if token == ANY else "segment")
            self.free[at].append(new)
        return new

    def _reach(self, at: int) -> tuple[int, ...]:
        """A place and those that nothing needs to be read for."""
        seen, todo = {at}, [at]
        while todo:
            for k in self.free[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return tuple(seen)

    def match(self, path: str) -> set:
        """Ids of the globs that a path fits."""
        found: set = set()
        now = set(self.open[0])
        for c in path:
            after: set[int] = set()
            for k in now:
                if c == "/":
                    found.update(self.below[k])
                    if self.slash[k]:
                        after.update(self.open[self.slash[k]])
                    if self.stays[k] == "all":
                        after.update(self.open[k])
                else:
                    if self.stays[k]:
                        after.update(self.open[k])
                    if self.one[k]:
                        after.update(self.open[self.one[k]])
                if c in self.steps[k]:
                    after.update(self.open[self.steps[k][c]])
            now = after
            if not now:
                return found
        for k in now:
            found.update(self.done[k])
            found.update(self.below[k])
        return found


def match_globs(rows: DataFrame, globs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, glob_id) of all paths and the globs that they fit. rows: file;
    globs: glob_id, glob. Null paths and globs fit nothing; repeats of a path
    stay, those of a pair of id and glob count once."""
    spark = rows.sparkSession
    wanted = globs.select("glob_id", "glob").where("glob is not null").distinct()
    blocks = max(1, -(-wanted.count() // block))
    kind = globs.schema["glob_id"].dataType.simpleString()
    arrow = to_arrow_type(globs.schema["glob_id"].dataType)

    def passing(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton: GlobSet = held.value
            for b in batches:
                paths = b.column(0).to_pylist()
                found = [sorted(automaton.match(p)) for p in paths]
                at = [k for k, ids in enumerate(found) for _ in ids]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([i for ids in found for i in ids], arrow)], names=["file", "glob_id"])

        return run

    parts = []
    for k in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("glob"), F.lit(blocks)) == k).collect()
        held = spark.sparkContext.broadcast(GlobSet([(r.glob_id, r.glob) for r in own]))
        parts.append(rows.select("file").where("file is not null").mapInArrow(passing(held), f"file string, glob_id {kind}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
