"""Groups of rows, many at a time, as Arrow tables.

Small groups are the rule after blocking; handing each to a function of its own
costs more than the work. Here rows are dealt by key, sorted, and handed over in
runs of whole groups with their bounds, so that small groups are computed
together in vectors. Groups must be bounded (see :func:`block_pairs`).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 48

BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


_kept: dict[str, dict] = {}


def keep(owner: str, key, make: Callable):
    """make(), kept in this process for the later tasks of the module ``owner``."""
    held = _kept.setdefault(owner, {})
    if key not in held:
        held[key] = make()
    return held[key]


def begin_task(owner: str) -> None:
    """Drop what tasks of other modules left in this process."""
    for other in [x for x in _kept if x != owner]:
        del _kept[other]


def end_task() -> None:
    """Hand free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) for texts: batches of BATCH_BYTES, and workers
    that hand their free memory back when a task is over.

    A batch of 10,000 texts takes several times its bytes on both sides of the
    pipe, and Python workers live on for the next tasks: what the allocators of
    Arrow and of the C library keep for later would count in every stage that
    follows. The bound is a setting of the session, as the plan runs after this
    returns; one that the session names itself stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, str(BATCH_BYTES))

    @wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(run.__module__)
        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(lean, schema)


def block_pairs(members: DataFrame, count: str, order: str, block: int) -> DataFrame:
    """Deal members of groups out to pairs of blocks of about ``block`` rows.

    Adds cell_a <= cell_b and mine, the row's own block; a group of at most
    ``block`` rows is one cell.
    """
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(order), F.col("blocks")).cast("int")
    return (
        members.withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"cell_a": F.least("mine", "other"), "cell_b": F.greatest("mine", "other")})
        .drop("blocks", "other")
    )


def map_groups(df: DataFrame, keys: list[str], then: str, columns: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, tasks: int | None = None) -> DataFrame:
    """fn(table, bounds) over runs of whole groups; keys are numeric, rows of a
    group are in the order of ``then``. With ``tasks`` the first key, a number
    below it, is the task itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            at = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            change = np.zeros(b.num_rows, bool)
            for k in at:
                change[1:] |= k[1:] != k[:-1]
            change[0] = last is not None and any(x[0] != y for x, y in zip(at, last, strict=True))
            last = [k[-1] for k in at]
            edge = np.flatnonzero(change)
            if len(edge):
                if edge[-1]:
                    held.append(b.slice(0, edge[-1]))
                yield from whole(held)
                held = [b.slice(edge[-1])]
            else:
                held.append(b)
        if held:
            yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(t.num_rows + 1, bool)
        change[[0, -1]] = True
        for k in keys:
            v = t[k].to_numpy()
            change[1:-1] |= v[1:] != v[:-1]
        yield from fn(t, np.flatnonzero(change))

    rows = df.select(*keys, then, *columns)
    dealt = rows.repartitionById(tasks, F.col(keys[0])) if tasks else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, then).transform(map_arrow, run, schema)


def small_pairs(bounds: np.ndarray, most: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs a < b of the groups of at most ``most`` rows."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
        i, j = np.triu_indices(size, 1)
        base = starts[sizes == size][:, None]
        left.append((base + i).ravel())
        right.append((base + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def fixed(column: pa.ChunkedArray, dtype, n: int) -> np.ndarray:
    """A binary column of equal lengths as (n, -1) numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(n, -1)
