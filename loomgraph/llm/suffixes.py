"""Suffix-array deduplication: strings of ``length`` bytes that start twice.

Every window of ``length`` bytes picks one of its K-byte substrings by a rule
that looks at the window's content alone (the rightmost of smallest hash), so
equal windows pick at equal offsets. Only suffixes that start at picked places,
about one in (length - K) / 2 bytes, are sorted:

1. a task sorts the suffixes of its documents, each cut where the last window
   that picked it ends, and with the bytes before it back to the first such
   window. Equal ones become one with a list of places;
2. sorted runs are front-coded (common prefix with the one before, and the
   rest) and exchanged, dealt by the hash of the K bytes;
3. runs are merged by a loser tree whose nodes carry the length of the prefix
   that a loser shares with the last winner, so that known prefixes are never
   compared again, and the merge yields the common-prefix array;
4. where K bytes or more are common, windows at equal offsets are compared by
   their common prefix to the right and common suffix to the left: the windows
   that occur twice.

K-byte strings so frequent that one would fill a task's share are found in a
sample of documents and are picked only by windows without any other. A window
that reaches over the edge of a frequent passage then goes with its rarer
side, and windows inside the passage are equal and merge where they are read;
the result does not depend on which strings are held frequent.

Defined results: null and short texts lose nothing; rows that repeat are
copies of each other; a text that repeats itself loses the repeats; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .grouped import map_arrow, map_groups
from .text import U, chunks, prefix_hash, span_hash, strings

LENGTH, K, SAMPLE, RUN_BYTES, BUCKET = 200, 32, 16, 40 << 20, 32 << 20
_PLACE = U((1 << 28) - 1)
_TOP = U(1 << 63)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position of a chunk."""
    if len(data) < K:
        return np.zeros(0, U)
    at = np.arange(len(data) - K + 1)
    return span_hash(prefix_hash(data), at, at + K)


class Frequent:
    """Membership in a sorted array of hashes, by a bitmap first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(U))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> U(44)).astype(np.int64)] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(h >> U(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = self.hashes[found] == h[at]
        return out


def picked(h: np.ndarray, length: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of all suffixes that windows pick."""
    wide = length - K + 1
    if len(h) < wide:
        none = np.zeros(0, np.int64)
        return none, none, none
    key = (h >> U(29) << U(28)) | (_PLACE - (np.arange(len(h), dtype=U) & _PLACE))
    if len(frequent.hashes):
        key |= np.where(frequent.among(h), _TOP, U(0))
    low, span = key, 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = wide - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    window = np.arange(len(low))
    #: the place modulo 2**28 is within the window: undo the modulus
    place = window + (((_PLACE - (low & _PLACE)) - window.astype(U)) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.append(first[1:], len(low)) - 1


def front_code(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, bytes]:
    """(common prefix with the row before, length left of it, of the part
    before) of sorted (suffix, before) rows, and the bytes."""
    head, body, last = np.zeros((len(rows), 3), np.int32), [], b""
    for k, (suffix, before) in enumerate(rows):
        n = common(last, suffix, 0)
        head[k] = n, len(suffix) - n, len(before)
        body.append(suffix[n:])
        body.append(before)
        last = suffix
    return head, b"".join(body)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known : known + 24], b[known : known + 24]
        if x != y:
            n = min(len(x), len(y))
            z = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
            return known + (n - (z.bit_length() + 7) // 8 if z else n)
        known += 24
    return end


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (suffix, common prefix with the one before, item)
    to one such run. Suffixes compare as bytes, a prefix before its extension.
    """
    size = 1
    while size < len(runs):
        size *= 2
    #: of each run's first remaining suffix: itself, its common prefix with the last winner, its item
    text: list[bytes | None] = [None] * size
    shared, items = [0] * size, [None] * size

    def advance(r: int) -> None:
        nxt = next(runs[r], None)
        if nxt is None:
            text[r] = None
        else:
            text[r], shared[r], items[r] = nxt

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the winner's."""
        x, y = text[a], text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        i, j = shared[a], shared[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        n = common(x, y, i)
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    for r in range(len(runs)):
        advance(r)
        shared[r] = 0
    loser = [0] * size
    level = list(range(size))
    base = size
    while len(level) > 1:
        base //= 2
        up = []
        for k in range(0, len(level), 2):
            w, x = play(level[k], level[k + 1])
            loser[base + k // 2] = x
            up.append(w)
        level = up
    winner = level[0]
    while text[winner] is not None:
        yield text[winner], shared[winner], items[winner]
        advance(winner)
        node = (winner + size) // 2
        while node:
            other = loser[node]
            w, x = play(winner, other)
            loser[node], winner = x, w
            node //= 2


def twice(members: list[tuple[bytes, bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """Offsets, as ranges, at which each member's windows also occur in another.

    A member is (suffix, before, least offset, greatest offset); the window at
    an offset o is the last o bytes before with the first length - o of the
    suffix. Members are distinct.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    if len(members) <= 8:
        for i, (s, p, lo, hi) in enumerate(members):
            for j in range(i):
                t, q, least, most = members[j]
                right = common(s, t, 0)
                left = common(p[::-1], q[::-1], 0)
                a, z = max(lo, least, length - right), min(hi, most, left)
                if a <= z:
                    out[i].append((a, z))
                    out[j].append((a, z))
        return out
    for o in range(min(m[2] for m in members), max(m[3] for m in members) + 1):
        seen: dict[bytes, int] = {}
        for i, (s, p, lo, hi) in enumerate(members):
            if lo <= o <= hi:
                window = p[len(p) - o :] + s[: length - o]
                first = seen.setdefault(window, i)
                if first != i:
                    out[i].append((o, o))
                    if first >= 0:
                        out[first].append((o, o))
                        seen[window] = -1
    return out


def _runs(rows: DataFrame, buckets: int, length: int, held) -> DataFrame:
    """Front-coded sorted runs: bucket, run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(held.value)
        pack = zstandard.ZstdCompressor(level=3)
        found: list[tuple[int, bytes, bytes, int, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found.sort()
            for bucket, part in groupby(found, key=lambda x: x[0]):
                texts, starts, places, last = [], [], [], None
                for _, suffix, before, doc, h, place in part:
                    if (suffix, before) != last:
                        last = (suffix, before)
                        texts.append(last)
                        starts.append(len(places))
                    places.append((doc is None, doc or 0, h, place))
                head, body = front_code(texts)
                where = np.array(places, np.int64)
                blob = b"".join([
                    np.array([len(texts), len(places), len(body)], np.int64).tobytes(), head.tobytes(), np.array(starts, np.int32).tobytes(), where.tobytes(), body,
                ])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([pack.compress(blob)], pa.binary())], names=["bucket", "tie", "run"])
            found.clear()

        for b in batches:
            data, off = strings(b.column(2))
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in chunks(off):
                part = data[off[a] : off[z]]
                h, raw = kmer_hashes(part), part.tobytes()
                for k in range(a, z):
                    lo, hi = int(off[k] - off[a]), int(off[k + 1] - off[a])
                    if hi - lo < length:
                        continue
                    own = h[lo : hi - K + 1]
                    places, first, last = picked(own, length, frequent)
                    dealt = (own[places] % U(buckets)).tolist()
                    for p, f, e, d in zip(places.tolist(), first.tolist(), last.tolist(), dealt, strict=True):
                        found.append((d, raw[lo + p : lo + e + length], raw[lo + f : lo + p], ids[k], hashes[k], p))
                    size += 4 * (hi - lo)
                    if size > RUN_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id"), "text_hash", "text").transform(map_arrow, run, "bucket int, tie int, run binary")


def _unpack(blob: bytes) -> tuple[Iterator[tuple[bytes, int, tuple]], np.ndarray, np.ndarray]:
    """A run as an iterator for the merge, and its places."""
    n, m, _ = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24
    head = np.frombuffer(blob, np.int32, 3 * n, at).reshape(n, 3)
    at += 12 * n
    starts = np.append(np.frombuffer(blob, np.int32, n, at), m)
    at += 4 * n
    where = np.frombuffer(blob, np.int64, 4 * m, at).reshape(m, 4)
    at += 32 * m

    def rows(own: int, at: int) -> Iterator[tuple[bytes, int, tuple]]:
        last = b""
        for k, (shared, more, back) in enumerate(head.tolist()):
            last = last[:shared] + blob[at : at + more]
            at += more
            yield last, shared, (own, k, blob[at : at + back])
            at += back

    return (lambda own, at=at: rows(own, at)), starts, where


def _classes(merged: Iterator[tuple[bytes, int, tuple]]) -> Iterator[list[tuple[bytes, tuple]]]:
    """Runs of suffixes whose first K bytes are common."""
    group: list[tuple[bytes, tuple]] = []
    for suffix, shared, item in merged:
        if shared < K and group:
            yield group
            group = []
        group.append((suffix, item))
    if group:
        yield group


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_hash, windows array<struct<first,last>>: the starts of the
    windows of each document that start anywhere else as well."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    frequent, buckets = _frequent(rows, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), length)
    held = spark.sparkContext.broadcast(frequent)
    runs = _runs(rows, buckets, length, held)

    def merge(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            parts = [_unpack(unpack.decompress(x.as_py())) for x in t["run"].slice(lo, hi - lo)]
            out: list[tuple] = []
            for group in _classes(merge_runs([p[0](k) for k, p in enumerate(parts)])):
                if len(group) == 1:
                    own, k, before = group[0][1]
                    if parts[own][1][k + 1] - parts[own][1][k] < 2:
                        continue
                same: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
                for suffix, (own, k, before) in group:
                    same.setdefault((suffix, before), []).append((own, k))
                members = [(s, p, length - min(len(s), length), len(p)) for s, p in same]
                found = twice(members, length) if len(members) > 1 else [[]]
                for (s, p, least, most), ranges, owners in zip(members, found, same.values(), strict=True):
                    if sum(int(parts[o][1][k + 1] - parts[o][1][k]) for o, k in owners) > 1:
                        ranges = [(least, most)]
                    for a, z in _joined(ranges):
                        for o, k in owners:
                            for none, doc, h, place in parts[o][2][parts[o][1][k] : parts[o][1][k + 1]].tolist():
                                out.append((doc, h, place - z, place - a))
                if len(out) > 100_000:
                    yield _places(out)
                    out = []
            yield _places(out)

    windows = map_groups(runs, ["bucket"], "tie", ["run"], merge, "doc_id long, text_hash long, first int, last int", tasks=buckets)
    return windows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("windows"))


def _places(out: list[tuple]) -> pa.RecordBatch:
    doc, h, first, last = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "text_hash", "first", "last"])


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges of integers, sorted."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def _frequent(rows: DataFrame, buckets: int, length: int) -> tuple[np.ndarray, int]:
    """Hashes of K-byte strings that are a bucket's share of all suffixes or
    more, as a sample of documents shows (at most about buckets * length), and
    the buckets: as many as given, or more so that each has BUCKET bytes of text
    at most, by the sample's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = strings(b.column(0))
            for a, z in chunks(off):
                h, n = np.unique(kmer_hashes(data[off[a] : off[z]]), return_counts=True)
                some = n > 1
                total = int(off[z] - off[a])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(h[some].view(np.int64), 0)), pa.array(np.append(n[some], 0).astype(np.int64)), pa.array(np.append(np.zeros(some.sum(), np.int64), total))], names=["h", "n", "bytes"])

    part = rows.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SAMPLE)) == 0).select("text")
    seen = cut(part.transform(map_arrow, run, "h long, n long, bytes long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "suffix-frequent")
    total = seen.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(buckets, -(-total * SAMPLE // BUCKET))
    share = max(24, total / ((length - K) / 2) / buckets)
    return seen.where(F.col("n") >= share).select("h").toArrow()["h"].to_numpy().view(U), buckets


def cut_out(raw: bytes, windows: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, maximal removed runs)."""
    spans: list[list[int]] = []
    for a, z in sorted(windows):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z + length)
        else:
            spans.append([a, z + length])
    keep, at = [], 0
    for a, z in spans:
        keep.append(raw[at:a])
        at = z
    keep.append(raw[at:])
    return b"".join(keep), sum(z - a for a, z in spans), len(spans)


def _with_windows(docs: DataFrame, length: int) -> DataFrame:
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    found = repeated_windows(docs, length).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "windows")
    #: both sides grow with the corpus: one plan at every size
    return keyed.join(found.hint("merge"), ["_id", "_hash"], "left").drop("_id", "_hash")


def _pairs(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(w["first"], w["last"]) for w in x or ()] for x in column.to_pylist()]


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, windows in zip(b.column(1), _pairs(b.column(2)), strict=True):
                raw = (text.as_py() or "").encode()
                kept, removed, spans = cut_out(raw, windows, length)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            size, removed, spans, digest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _with_windows(docs.select("doc_id", "text"), length).select("doc_id", "text", "windows")
    return joined.transform(map_arrow, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeats taken out of ``text``; characters that a cut
    splits go as well. A null text stays null."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                None if t is None else cut_out(t.encode(), w, length)[0].decode("utf-8", "ignore") if w else t
                for t, w in zip(b.column(at).to_pylist(), _pairs(b.column(len(names))), strict=True)
            ]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _with_windows(docs, length).select(*names, "windows").transform(map_arrow, run, fields)
