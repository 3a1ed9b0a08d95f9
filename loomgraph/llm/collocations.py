"""Collocations: phrases whose words stand together more than apart.

A-Z count as a-z. Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
at blanks and tabs into words; all is counted for each language apart. A phrase
is two to four words of one piece.

1. every task counts its words and phrases in a count-min sketch (two rows of
   ``2**bits`` cells, by one 64-bit hash of language and words). Sketches are cut
   into slices, which are shuffled and summed. A cell's sum is at least the count
   of each phrase in it. What is broadcast is one bit a cell: whether the sum
   reaches ``least``;
2. a second pass over the texts counts exactly, by the words themselves, the
   phrases whose cells reach ``least`` and whose parts' cells do: no phrase that
   is frequent is lost, as its parts are at least as frequent. A task counts its
   own before anything is shuffled;
3. a cut of a candidate after k words scores 2000000 * a / (l + r), rounded down;
   the least cut counts. A candidate goes if a longer one around it has at least
   four fifths of its occurrences. The best of each language are found in three
   steps, so that no task sorts all of a language.

The sketch's width follows the bytes of text up to 2**MOST cells. Beyond that it
rejects less, and the second pass counts more; results don't depend on it.

Defined results: null and empty texts have no words; a null language is
``und``, and one with that name joins it; rows that repeat count as often as
they stand; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard
from .grouped import map_arrow
from .text import LOWER, U, chunks, mix, prefix_hash, runs, span_hash, strings

LEAST, TOP, WORDS, MOST = 30, 2000, 4, 26
SLICE, STEP, LIMIT, CHUNK = 1 << 16, 1 << 15, (1 << 15) - 1, 2 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[0x2C, 0x2E, 0x3A, 0x3B, 0x21, 0x3F, 10, 11, 12, 13]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False


class Words:
    """The words of a chunk of rows: bytes, bounds, piece, language, hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray, salts: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end, first = runs(_INSIDE[self.data], off)
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        #: pieces end at a mark or with the row: both only grow
        self.piece = np.cumsum(_ENDS[self.data])[self.start] + row if len(self.start) else self.start
        self.lang = langs[row]
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)
        self.single = mix(self.hash + salts[self.lang])

    def longer(self, phrases: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each place, from those of one less."""
        return mix(phrases * U(0x9E3779B97F4A7C15) + self.hash[at + size - 1])

    def together(self, at: np.ndarray, size: int) -> np.ndarray:
        """Places among ``at`` from which ``size`` words are in one piece."""
        at = at[at + size <= len(self.piece)]
        return at[self.piece[at] == self.piece[at + size - 1]]

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The words from each place, joined by one blank."""
        own = at[:, None] + np.arange(size)
        begin, width = self.start[own], self.end[own] - self.start[own]
        total = width.sum(axis=1) + size - 1
        off = np.concatenate([[0], np.cumsum(total)])
        out = np.full(off[-1], 0x20, np.uint8)
        to = off[:-1, None] + np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(width + 1, axis=1)[:, :-1]], axis=1)
        begin, width, to = begin.ravel(), width.ravel(), to.ravel()
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        out[np.repeat(to, width) + step] = self.data[np.repeat(begin, width) + step]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.string())


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << bits) - 1)
    return (h & mask).astype(np.int64), (h >> U(32) & mask).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Words, list[str]]]:
    """Words of chunks of (lang, text) rows, and the names of the languages."""
    for b in batches:
        named = b.column(0).dictionary_encode()
        names = named.dictionary.to_pylist()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], U)
        langs = named.indices.to_numpy()
        data, off = strings(b.column(1))
        for a, z in chunks(off, most):
            yield Words(data[off[a] : off[z]], off[a : z + 1] - off[a], langs[a:z], salts), names


def _sketch(bits: int):
    """Slices of a task's sketch, and its words by language under slice -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, 1 << bits), np.uint16)
        seen: dict[str, int] = {}
        one = np.uint16(1)

        def count(h: np.ndarray) -> None:
            for row, cells in zip(rows, _cells(h, bits), strict=True):
                for a in range(0, len(cells), STEP):
                    some = cells[a : a + STEP]
                    np.add.at(row, some, one)
                    row[some] = np.minimum(row[some], LIMIT)

        for words, names in _texts(batches, 1 << 19):
            for k, n in enumerate(np.bincount(words.lang, minlength=len(names)).tolist()):
                seen[names[k]] = seen.get(names[k], 0) + n
            at, h = np.arange(len(words.start)), words.single
            count(h)
            for size in range(2, WORDS + 1):
                on = words.together(at, size)
                h = words.longer(h[np.searchsorted(at, on)], on, size)
                at = on
                count(h)
        pack = zstandard.ZstdCompressor(level=1)
        for k, part in enumerate(rows.reshape(-1, min(SLICE, 1 << bits))):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "lang": [""], "n": [0], "cells": pa.array([pack.compress(part.tobytes())], pa.binary())})
        if seen:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([-1] * len(seen), pa.int32()), "lang": list(seen), "n": list(seen.values()), "cells": pa.array([None] * len(seen), pa.binary())})

    return run


def _merge(least: int):
    """Sums of slices as bits: the cells that reach ``least``. A counter at LIMIT
    has stopped and counts as frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        langs: dict[str, int] = {}
        for b in batches:
            for k, lang, n, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k < 0:
                    langs[lang] = langs.get(lang, 0) + n
                    continue
                part = np.frombuffer(unpack.decompress(cells), np.uint16).astype(np.int64)
                part = np.minimum(np.where(part == LIMIT, least, part), least)
                sums[k] = np.minimum(sums[k] + part, least) if k in sums else part
        for k, part in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "lang": [""], "n": [0], "cells": pa.array([np.packbits(part >= least, bitorder="little").tobytes()], pa.binary())})
        if langs:
            yield pa.RecordBatch.from_pydict({"slice": pa.array([-1] * len(langs), pa.int32()), "lang": list(langs), "n": list(langs.values()), "cells": pa.array([None] * len(langs), pa.binary())})

    return run


def _count(held, bits: int):
    """(lang, size, phrase, n) of a chunk's phrases that can be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (np.frombuffer(x, np.uint8) for x in held.value)

        def frequent(h: np.ndarray) -> np.ndarray:
            a, b = _cells(h, bits)
            return (first[a >> 3] >> (a & 7) & second[b >> 3] >> (b & 7) & 1).astype(bool)

        for words, names in _texts(batches, CHUNK):
            langs = pa.array(names, pa.string())
            h = words.single
            at = np.flatnonzero(frequent(h))
            h = h[at]
            for size in range(1, WORDS + 1):
                if size > 1:
                    #: both parts of one word less are frequent, and in one piece
                    after = np.searchsorted(at, at + 1)
                    both = np.append(at, -1)[after] == at + 1
                    on = words.together(at[both], size) if size == 2 else at[both]
                    more = words.longer(h[np.searchsorted(at, on)], on, size)
                    some = frequent(more)
                    at, h = on[some], more[some]
                if not len(at):
                    break
                _, spot, n = np.unique(h, return_index=True, return_counts=True)
                where = at[spot]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(words.lang[where])), pa.array(np.full(len(where), size, np.int32)), words.phrases(where, size), pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all words and phrases of at most WORDS words
    that occur ``least`` times in their language; (lang, n) with all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(16, (size // 32).bit_length()))
    schema = "slice int, lang string, n long, cells binary"
    merged = rows.transform(map_arrow, _sketch(bits), schema).repartition("slice", "lang").transform(map_arrow, _merge(least), schema)
    merged = cut(merged, "sketch")
    bitmap = [bytearray(1 << bits >> 3) for _ in range(2)]
    width = min(SLICE, 1 << bits) >> 3
    for k, cells in merged.where("slice >= 0").select("slice", "cells").toLocalIterator():
        row, at = divmod(k * width, 1 << bits >> 3)
        bitmap[row][at : at + width] = cells
    held = spark.sparkContext.broadcast([bytes(x) for x in bitmap])
    counted = rows.transform(map_arrow, _count(held, bits), "lang string, size int, phrase string, n long")
    counts = cut(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
    totals = cut(merged.where("slice < 0").groupBy("lang").agg(F.sum("n").alias("n")), "words")
    discard(merged)
    return counts, totals


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` of each language."""
    counts, totals = frequent_phrases(docs, least)
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = (
        found.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
        .join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    )
    #: decimal, as the product and the sum can pass 64 bits
    scored = cuts.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), b -> array_join(slice(split(phrase, ' '), b, n), ' '))))")
    around = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = least_cut.join(around, ["lang", "phrase"], "left").where(F.col("over").isNull() | (_wide("over") * 100 < _wide("a") * 80))
    best = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    deal = F.pmod(F.xxhash64("phrase"), F.lit(4096))
    for salt in (deal, F.pmod(deal, F.lit(64)), F.lit(0)):
        order = Window.partitionBy("lang", salt).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
