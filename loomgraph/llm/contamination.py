"""Benchmark decontamination by suffix arrays of the training texts.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became
a-z. A window is ``window`` consecutive words of an item; an item of fewer words
is one window. A document's word is hit if it lies in an occurrence of a window.

1. the benchmark is cut into segments that overlap by all but one word of a
   window, so that no segment is longer than SEGMENT words, and the segments are
   dealt to blocks of BLOCK words at most. A block is what is broadcast;
2. a task builds a suffix array for every shard of its documents (about SHARD bytes, one
   document at least): places whose word the block has, sorted by as many words as
   fit into one 64-bit key;
3. every suffix of the benchmark that holds a window is binary-searched in the
   array. Where it is found deeper than the array is sorted, the array's
   interval is sorted by the next word, and the search goes on, until no place
   agrees: that is the longest verbatim match, and the interval of the window's
   depth has all of its places.

Nothing is shuffled; a window that all documents have is one interval of each
shard. Equal words are told by 64-bit hashes of their bytes.

Defined results: null and wordless texts have no words and no hits; items
without words have no windows; a null item_id counts as an id written as empty
string; rows that repeat are judged alike; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .grouped import map_arrow
from .text import LOWER, U, chunks, mix, prefix_hash, runs, span_hash, strings

WINDOW, SEGMENT, BLOCK, SHARD = 10, 1 << 12, 1 << 19, 4 << 20
_WORDY = np.zeros(256, bool)
_WORDY[0x30:0x3A] = _WORDY[0x61:0x7B] = _WORDY[0x80:] = True

MATCH = "struct<word int, n_words int, item_id string, item_word long>"


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a chunk of rows, and where each row's begin."""
    low = LOWER[data]
    start, end, first = runs(_WORDY[low], off)
    return span_hash(prefix_hash(low), start, end), first


def segments(benchmark: DataFrame, window: int = WINDOW, segment: int = SEGMENT) -> DataFrame:
    """item_id string, begin long, short boolean, words binary: the word hashes
    of the items, cut into segments that share all windows between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = strings(b.column(1))
            for a, z in chunks(off):
                h, first = word_hashes(data[off[a] : off[z]], off[a : z + 1] - off[a])
                rows = []
                for k in range(a, z):
                    lo, hi = int(first[k - a]), int(first[k - a + 1])
                    step = segment - window + 1
                    for s in range(lo, max(lo + 1, hi - window + 1), step) if hi > lo else ():
                        rows.append((k, s - lo, hi - lo < window, h[s : min(s + segment, hi)].tobytes()))
                if rows:
                    own, begin, short, packed = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(begin, pa.int64()), pa.array(short, pa.bool_()), pa.array(packed, pa.binary())], names=["item_id", "begin", "short", "words"])

    kept = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return kept.transform(map_arrow, run, "item_id string, begin long, short boolean, words binary")


class Suffixes:
    """The suffixes of a block's segments that begin with a window."""

    def __init__(self, rows: pa.Table, window: int):
        packed = rows["words"].to_pylist()
        sizes = np.array([len(x) // 8 for x in packed], np.int64)
        flat = np.frombuffer(b"".join(packed), U)
        short = rows["short"].to_numpy()
        self.vocabulary = np.unique(flat)
        self.words = np.append(np.searchsorted(self.vocabulary, flat) + 1, 0).astype(np.int32)
        self.bits = max(1, len(self.vocabulary).bit_length())
        #: words in a key
        self.wide = max(1, min(window, 63 // self.bits))
        held = np.where(short, 1, np.maximum(sizes - window + 1, 0))
        own = np.repeat(np.arange(len(sizes)), held)
        within = np.arange(len(own)) - np.repeat(np.cumsum(held) - held, held)
        #: of each suffix: its place, the words from there, those of its window
        self.at = (np.cumsum(sizes) - sizes)[own] + within
        self.left = (sizes[own] - within).astype(np.int32)
        self.need = np.where(short[own], sizes[own], window).astype(np.int32)
        names = rows["item_id"].combine_chunks().dictionary_encode()
        self.names = names.dictionary.to_pylist()
        self.item = names.indices.to_numpy()[own] if len(own) else np.zeros(0, np.int32)
        self.place = rows["begin"].to_numpy()[own] + within
        #: suffixes with equal windows share a number; the items of each number
        h = self.need.astype(U)
        for k in range(window):
            inside = k < self.need
            h = mix(h) + np.where(inside, self.words[np.where(inside, self.at + k, -1)], 0).astype(U)
        self.same = np.unique(h, return_inverse=True)[1].astype(np.int32)
        pairs = np.unique(np.stack([self.same, self.item]), axis=1) if len(own) else np.zeros((2, 0), np.int32)
        self.owners = np.split(pairs[1], np.flatnonzero(np.diff(pairs[0])) + 1)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Number of each word in the block's vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)


def spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, lo + size), one range after the other."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Shard:
    """A suffix array over the numbers of a shard's words, a 0 after each
    document, searched with all suffixes of a block.

    ``array`` has the places, sorted as deep as the searches had to go;
    ``longest`` the words of the longest match from each place, ``best`` a
    suffix that has it; ``windows`` rows (from, to, suffix) of the intervals of
    the array where a window stands.
    """

    def __init__(self, words: np.ndarray, tests: Suffixes):
        self.words, self.tests = words, tests
        self.longest, self.best = np.zeros(len(words), np.int32), np.full(len(words), -1, np.int32)
        self.windows = [np.zeros((3, 0), np.int64)]
        places = np.flatnonzero(words)
        key = self._keys(words, places, np.full(len(places), tests.wide))
        order = np.argsort(key)
        self.array = places[order]
        first = np.minimum(tests.need, tests.wide)
        low = self._keys(tests.words, tests.at, first)
        key = key[order]
        lo = np.searchsorted(key, low)
        hi = np.searchsorted(key, low + ((np.int64(1) << (tests.wide - first) * tests.bits) - 1), "right")
        for depth in np.unique(first).tolist():
            own = np.flatnonzero((first == depth) & (hi > lo))
            self._descend(own, lo[own], hi[own], depth)

    def _keys(self, words: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The first words from each place as one number; no word counts as 0."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.tests.wide):
            i = at + k
            out = out << self.tests.bits | np.where((i < len(words)) & (k < count), words[np.minimum(i, len(words) - 1)], 0)
        return out

    def _descend(self, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> None:
        """Search on with suffixes that agree with array[lo:hi] for depth words."""
        tests, bits = self.tests, np.int64(self.tests.bits)
        while len(own):
            whole = np.flatnonzero(tests.need[own] <= depth)
            just = whole[tests.need[own[whole]] == depth]
            _, one = np.unique(tests.same[own[just]], return_index=True)
            self.windows.append(np.stack([lo[just[one]], hi[just[one]], own[just[one]]]))
            #: at one depth, intervals are equal or apart
            start, one = np.unique(lo[whole], return_index=True)
            size = hi[whole[one]] - start
            found = self.array[spread(start, size)]
            longer = self.longest[found] < depth
            self.longest[found[longer]] = depth
            self.best[found[longer]] = np.repeat(own[whole[one]], size)[longer]
            on = tests.left[own] > depth
            own, lo, hi = own[on], lo[on], hi[on]
            start, one, mine = np.unique(lo, return_index=True, return_inverse=True)
            size = hi[one] - start
            spot = spread(start, size)
            code = np.repeat(np.arange(len(start)), size) << bits | self.words[self.array[spot] + depth]
            order = np.argsort(code)
            self.array[spot], code = self.array[spot[order]], code[order]
            want = mine << bits | tests.words[tests.at[own] + depth]
            base = (start - (np.cumsum(size) - size))[mine]
            lo, hi = np.searchsorted(code, want) + base, np.searchsorted(code, want, "right") + base
            on = hi > lo
            own, lo, hi, depth = own[on], lo[on], hi[on], depth + 1

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, suffix whose window stands there) of all windows."""
        lo, hi, test = np.concatenate(self.windows, axis=1)
        return self.array[spread(lo, hi - lo)], np.repeat(test, hi - lo)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges of word numbers, sorted."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def _shard_rows(column: pa.Array, tests: Suffixes) -> tuple[np.ndarray, dict[int, tuple[list, list, list]]]:
    """Words of each document of a shard, and of those with hits: spans of
    words, ids of items, matches that no other match contains."""
    data, off = strings(column)
    parts, sizes = [], []
    for a, z in chunks(off):
        h, first = word_hashes(data[off[a] : off[z]], off[a : z + 1] - off[a])
        parts.append(tests.numbers(h))
        sizes.append(np.diff(first))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    begin = np.cumsum(size + 1) - size - 1
    words = np.zeros(int(size.sum()) + len(size), np.int32)
    words[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.concatenate(parts) if parts else 0
    shard = Shard(words, tests)
    at, test = shard.places()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.need[test], -1)
    hit = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
    owner = lambda x: np.searchsorted(begin, x, "right") - 1
    out: dict[int, tuple[list, list, list]] = {}
    #: a 0 between documents is never hit, so spans end within them
    for a, z, k in zip(turn[::2].tolist(), turn[1::2].tolist(), owner(turn[::2]).tolist(), strict=True):
        out.setdefault(k, ([], [], []))[0].append((a - int(begin[k]), z - 1 - int(begin[k])))
    own = owner(at)
    pairs = np.unique(own * np.int64(len(tests.owners)) + tests.same[test]) if len(at) else at
    ids: dict[int, set[int]] = {}
    for k, window in zip((pairs // len(tests.owners)).tolist(), (pairs % len(tests.owners)).tolist(), strict=True):
        ids.setdefault(k, set()).update(tests.owners[window].tolist())
    for k, found in ids.items():
        out[k][1].extend(tests.names[i] for i in found)
    some = np.flatnonzero(shard.longest)
    end = some + shard.longest[some]
    top = np.maximum.accumulate(end)
    lead = some[np.concatenate([[True], end[1:] > top[:-1]])] if len(some) else some
    for p, k, n, t in zip(lead.tolist(), owner(lead).tolist(), shard.longest[lead].tolist(), shard.best[lead].tolist(), strict=True):
        out[k][2].append((p - int(begin[k]), n, tests.names[tests.item[t]], int(tests.place[t])))
    return size, out


FOUND = {"n_words": "long", "hits": "array<struct<first:int,last:int>>", "item_ids": "array<string>", "matches": f"array<{MATCH}>"}
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_MATCHES = pa.list_(pa.struct([("word", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.string()), ("item_word", pa.int64())]))


def _search_block(held, text: str, keeps: list[str]):
    """A pass over rows with what earlier blocks found in FOUND's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Suffixes = held.value
        for b in batches:
            column = b.column(text)
            _, off = strings(column)
            sizes, hits, ids, matches = [], [], [], []
            before = [b.column(f"_{name}").to_pylist() for name in ("hits", "item_ids", "matches")]
            for a, z in chunks(off, SHARD):
                size, found = _shard_rows(column.slice(a, z - a), tests)
                sizes.append(size)
                for k in range(a, z):
                    spans, items, some = found.get(k - a, ((), (), ()))
                    hits.append([{"first": x, "last": y} for x, y in _joined([*((s["first"], s["last"]) for s in before[0][k] or ()), *spans])])
                    ids.append(sorted({*(before[1][k] or ()), *items}))
                    matches.append([*(before[2][k] or ()), *({"word": w, "n_words": n, "item_id": i, "item_word": p} for w, n, i, p in some)])
            new = [pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(hits, _HITS), pa.array(ids, pa.list_(pa.string())), pa.array(matches, _MATCHES)]
            yield pa.RecordBatch.from_arrays([*(b.column(name) for name in keeps), *new], names=[*keeps, *(f"_{name}" for name in FOUND)])

    return run


def _searched(rows: DataFrame, text: str, keeps: list[str], benchmark: DataFrame, window: int) -> DataFrame:
    """Columns ``keeps`` of rows and FOUND with a _ before each name: a pass over
    the texts for each block of the benchmark."""
    spark = rows.sparkSession
    parts = cut(segments(benchmark, window), "benchmark")
    total = parts.agg(F.sum(F.length("words")) / 8).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.select("*", *(F.lit(None).cast(kind).alias(f"_{name}") for name, kind in FOUND.items()))
    done: DataFrame | None = None
    for block in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("item_id", "begin"), F.lit(blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast(Suffixes(own, window))
        last = block == blocks - 1
        names = keeps if last else list(dict.fromkeys([*keeps, text]))
        schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), *(f"`_{n}` {kind}" for n, kind in FOUND.items())])
        rows = rows.select(*dict.fromkeys([*names, text]), *(f"_{n}" for n in FOUND)).transform(map_arrow, _search_block(held, text, names), schema)
        if not last:
            rows, old = cut(rows, "searched"), done
            done = rows
            if old is not None:
                discard(old)
    discard(parts)
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (spans of word numbers in windows' occurrences),
    item_ids (of items with occurring windows, sorted as strings), longest (words
    of the longest verbatim match that holds a window, 0 if none), matches (those
    that no longer one contains: word, length, item and the item's word)."""
    rows = docs.select("doc_id", "text").toDF("c0", "c1")
    found = _searched(rows, "c1", ["c0"], benchmark, window)
    longest = F.coalesce(F.array_max(F.transform("_matches", lambda m: m["n_words"])), F.lit(0))
    return found.select(F.col("c0").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_hits").alias("hits"), F.col("_item_ids").alias("item_ids"), longest.alias("longest"), F.col("_matches").alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows whose text has a window of the benchmark; all
    columns stay, whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    found = _searched(docs.toDF(*names), names[docs.columns.index("text")], names, benchmark, window)
    return found.where(F.size("_hits") == 0).select(*names).toDF(*docs.columns)


def contamination_digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return leaks(docs, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), F.col("longest").cast("long").alias("longest"),
    )
