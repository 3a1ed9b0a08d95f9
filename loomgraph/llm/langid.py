"""Language identification by nearest centroid.

Texts become counts of hashed byte 2- to 4-grams of their letters (A-Z as a-z,
every other ASCII character as one space), weighted by 1 + log(count) and inverse
document frequency and scaled to length 1. The labelled sample of each language
is split into several centroids by spherical k-means. A text gets the language
of the nearest centroid by cosine; one whose cosine is below the rejection
distance is marked as rejected, and keeps its nearest language.

The rejection distance is learned for each language and size of text (powers of
two of its grams), because cosines grow with length: a quarter of the sample is
held back from the centroids, cut to lengths of 4 to 4096 bytes and scored, and
SLACK of the lowest hundredth of those scores is the least cosine. A size with
fewer than LEAST held-back texts takes the next smaller size's; REJECT is the
floor of all.

The classifier is fitted on a bounded sample: at most ``cells`` documents a
language, those of the smallest hash in each of ``cells`` hash cells (one
aggregation with map-side minima, no sort of a language). Only the sample comes
to the driver, as sparse counts; prediction runs over whole texts of all rows.

Defined results: null texts and texts without a letter are ``und`` with score
0 and rejected; without any labelled row everything is ``und``; rows that
repeat are predicted alike; labels never reach a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import map_arrow
from .text import U, chunks, mix, strings

DIMS, CELLS, CENTROIDS, ROUNDS, REJECT = 1 << 15, 768, 4, 8, 0.03
HELD, TAIL, SLACK, LEAST, LENGTHS, SIZES = 4, 0.01, 0.5, 20, [1 << k for k in range(2, 13)], 15
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def count_grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, counts) of each text."""
    data, off = strings(column)
    for a, z in chunks(off):
        raw = _CLEAN[data[off[a] : off[z]]]
        wide = np.concatenate([raw, np.full(4, 32, np.uint8)]).astype(np.uint32)
        pair = wide[:-3] << np.uint32(8) | wide[1:-2]
        three = pair << np.uint32(8) | wide[2:-1]
        four = three << np.uint32(8) | wide[3:]
        n = len(raw)
        dims = [((g[:n] * np.uint32(m)) >> np.uint32(17)).astype(np.int32) for g, m in ((pair, 2654435761), (three, 2246822519), (four, 3266489917))]
        blank = (raw == 32) & (wide[1 : n + 1] == 32)
        for k in range(a, z):
            lo, hi = off[k] - off[a], off[k + 1] - off[a]
            parts = []
            for size, d in zip((2, 3, 4), dims, strict=True):
                inside = d[lo : max(lo, hi - size + 1)]
                parts.append(inside[~blank[lo : lo + len(inside)]])
            counts = np.bincount(np.concatenate(parts), minlength=DIMS)
            at = np.flatnonzero(counts)
            yield at, counts[at]


def _packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(at.astype(np.uint16).tobytes() + counts.astype(np.int32).tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint16, n).astype(np.int32), np.frombuffer(raw, np.int32, n, 2 * n)


def size_of(counts: np.ndarray) -> int:
    """Which power of two of grams a text has."""
    return min(SIZES - 1, int(counts.sum()).bit_length())


@dataclass
class Centroids:
    """langs[k] is the language of row k of the (centroids, DIMS) matrix;
    least[k, size] is the least cosine of its texts, where that is learned."""

    langs: list[str]
    idf: np.ndarray
    rows: np.ndarray
    least: np.ndarray | None = None

    def weigh(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[at]
        size = np.sqrt((w * w).sum())
        return w / size if size else w

    def nearest(self, vectors: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, float, int]]:
        """Nearest centroid, cosine and size of each text's counts."""
        by_dim = np.ascontiguousarray(self.rows.T)
        for at, counts in vectors:
            near = self.weigh(at, counts).astype(np.float32) @ by_dim[at]
            best = int(near.argmax())
            yield best, min(1.0, max(0.0, float(near[best]))), size_of(counts)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, cosine and least cosine of each text."""
        best, score, least = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column))
        for k, (b, x, size) in enumerate(self.nearest(count_grams(column))):
            best[k], score[k] = b, x
            if self.least is not None:
                least[k] = self.least[b, size]
        return best, score, least

    def learn_least(self, langs: list[str], vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The least cosines from texts that the centroids weren't fitted on."""
        seen: dict[tuple[str, int], list[float]] = {}
        for lang, (best, score, size) in zip(langs, self.nearest(vectors), strict=True):
            #: a label that the text contradicts says nothing of its language
            if self.langs[best] == lang:
                seen.setdefault((lang, size), []).append(score)
        self.least = np.zeros((len(self.langs), SIZES))
        for k, lang in enumerate(self.langs):
            now = 0.0
            for size in range(SIZES):
                got = seen.get((lang, size), ())
                if len(got) >= LEAST:
                    now = SLACK * float(np.quantile(got, TAIL))
                self.least[k, size] = now


def fit_centroids(langs: list[str], vectors: list[tuple[np.ndarray, np.ndarray]], k: int = CENTROIDS, rounds: int = ROUNDS) -> Centroids:
    """Spherical k-means inside each language; farthest-first starts."""
    seen = np.zeros(DIMS)
    for at, _ in vectors:
        seen[at] += 1
    model = Centroids([], np.log((1 + len(vectors)) / (1 + seen)) + 1, np.zeros((0, DIMS), np.float32))
    for lang in sorted(set(langs)):
        mine = [v for own, v in zip(langs, vectors, strict=True) if own == lang]
        n, at = len(mine), np.concatenate([v[0] for v in mine])
        x, row = np.concatenate([model.weigh(*v) for v in mine]), np.repeat(np.arange(n), [len(v[0]) for v in mine])

        def total(rows: np.ndarray) -> np.ndarray:
            inside = rows[row]
            return np.bincount(at[inside], x[inside], DIMS)

        def cosines(c: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(row, x * one[at], n) for one in c], axis=1)

        picks = [int(cosines(total(np.ones(n, bool))[None])[:, 0].argmax())]
        while len(picks) < min(k, n):
            picks.append(int(cosines(np.stack([total(np.arange(n) == j) for j in picks])).max(axis=1).argmin()))
        c = np.stack([total(np.arange(n) == j) for j in picks])
        for _ in range(rounds):
            own = cosines(c).argmax(axis=1)
            c = np.stack([total(own == j) if (own == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        #: a centroid of a few odd texts says little of its language
        share = np.bincount(cosines(c).argmax(axis=1), minlength=len(c)) / n
        c = c[share >= min(0.02, share.max())]
        model.langs += [lang] * len(c)
        model.rows = np.concatenate([model.rows, c.astype(np.float32)])
    return model


def learn(labelled: DataFrame, cells: int = CELLS) -> Centroids | None:
    """Fit on labelled (doc_id, text, lang) rows; None without any. One in HELD
    rows of the sample is held back for the rejection distances, where a
    language has LEAST rows for each of both parts."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text", "doc_id").alias("h"))
    least = rows.groupBy("lang", F.pmod(F.shiftrightunsigned("h", 33), F.lit(cells)).alias("cell")).agg(F.min("h").alias("h"))
    picked = rows.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h"])

    sizes = least.groupBy("lang").agg(F.count("*").alias("cells"))
    aside = (F.col("cells") >= LEAST * HELD * 2) & (F.pmod("h", F.lit(HELD)) == 0)
    picked = picked.join(F.broadcast(sizes), "lang").withColumn("aside", aside)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang, h, back in zip(*(x.to_pylist() for x in b.columns), strict=True):
                raw = text.encode()
                cuts = [raw[:n].decode(errors="ignore") for n in LENGTHS if n <= len(raw)] if back else [text]
                sparse = [_packed(*x) for x in count_grams(pa.array(cuts, pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(cuts), t) for x, t in ((lang, pa.string()), (h, pa.int64()), (back, pa.bool_()))] + [pa.array(sparse, pa.binary())], names=["lang", "h", "aside", "grams"])

    got = picked.select("text", "lang", "h", "aside").mapInArrow(grams, "lang string, h long, aside boolean, grams binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("h", "ascending")])
    langs, back = np.array(got["lang"].to_pylist(), object), np.array(got["aside"].to_pylist(), bool)
    vectors = [_unpacked(x.as_py()) for x in got["grams"]]
    model = fit_centroids(list(langs[~back]), [v for v, held in zip(vectors, back, strict=True) if not held])
    model.learn_least(list(langs[back]), [v for v, held in zip(vectors, back, strict=True) if held])
    return model


def identify(docs: DataFrame, model: Centroids | None, reject: float = REJECT) -> DataFrame:
    """All columns of docs with lang_pred, score and rejected; columns of docs
    that have these names give way."""
    docs = docs.drop("lang_pred", "score", "rejected")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # centroids * DIMS floats: fixed by parameters
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for b in batches:
            text = b.column(at)
            if text.null_count:
                text = pc.fill_null(text, "")
            letters = np.array(pc.match_substring_regex(text, r"\p{L}").to_pylist(), bool)
            if found is None:
                langs, score, far = ["und"] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            else:
                best, score, least = found.predict(text)
                score = np.where(letters, score, 0.0)
                langs = [found.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                far = ~letters | (score < np.maximum(reject, least))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.transform(map_arrow, run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(doc_id="doc_id", folds: int = 4) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)) == 2


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(slim, model).drop("text")
