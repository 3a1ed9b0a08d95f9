"""Brown class-based bigrams: P(w | v) = P(class w | class v) * P(w | class w).

Words are the runs of ``[^\\x20\\x09-\\x0D]`` with A-Z as a-z; every text ends
with one end token, which is also the context of its first word.

Exchange clustering moves types between classes to raise the likelihood of the
class bigrams. Types are the words with at least 1 / 2**12 of all training
tokens (at most 4096 by pigeonhole) and 2048 buckets of word endings, which at
first stand for all other words. A pass over the corpus counts, for every type,
the classes before and after it; a sweep then moves each type to the class where
those counts fit best. Passes and sweeps alternate.

Then every other word of the training texts, however rare, is counted with the
classes before and after it and moves to the class where its own counts fit
best, by the same criterion: distributed, one row for each word and class
beside it, against the broadcast sums of the frequent words in each class. Only words that no
training text holds take the class of their ending. The number of classes grows with the vocabulary.

Transitions are smoothed towards class frequencies, emissions by adding DELTA
to every word of a class and to one unknown word.

Words are known by 64-bit hashes of their bytes: a chunk of texts is hashed in
vectors, and two words of one hash (odds of V**2 / 2**65) would count as one.
Counts cover the whole corpus and stay distributed. Words with at least
1 / 2**18 of the tokens (at most 2**18 by pigeonhole) are broadcast with their
counts and classes; a text's other words meet theirs in a join, one row for each
distinct word of a distinct text, and come back to the text as one list. None of
those words is frequent, so the join has no hot key.

Defined results: a null text is empty and scores its end token; repeated rows
are scored alike; without training rows every probability is that of an
unknown word; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .text import LOWER, U, chunks, mix, prefix_hash, span_hash, strings, words

CLASSES, ENDINGS, HEAD_SHIFT, COMMON_SHIFT, PASSES, SWEEPS = 32, 2048, 12, 18, 2, 3
DELTA, KAPPA, FLUSH, BLOCK, GROWTH = 0.4, 32.0, 1 << 20, 128, 0.3
END = U(1)  # the end token in place of a word's hash


def hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last, word hashes, buckets of endings, where rows begin) of
    chunks of rows; every row ends with the end token."""
    data, off = strings(column)
    for a, z in chunks(off):
        low, rows = LOWER[data[off[a] : off[z]]], z - a
        s, e, first = words(low, off[a : z + 1] - off[a])
        prefix = prefix_hash(low)
        at = np.arange(len(s)) + np.repeat(np.arange(rows), np.diff(first))
        word, ending = np.full(len(s) + rows, END), np.zeros(len(s) + rows, np.int64)
        word[at] = span_hash(prefix, s, e)
        ending[at] = (span_hash(prefix, np.maximum(s, e - 3), e) % U(ENDINGS)).astype(np.int64)
        yield a, z, word, ending, first + np.arange(rows + 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, beside, n) rows with equal keys added up."""
    word, beside, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, at, inverse = np.unique(mix(word + mix(beside.astype(U))), return_index=True, return_inverse=True)
    return word[at], beside[at], np.bincount(inverse, n).astype(np.int64)


def _counted(rows: DataFrame, pairs) -> DataFrame:
    """word, beside, n: sums of what ``pairs`` yields of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            word, beside, n = _summed(parts)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(beside.astype(np.int32)), pa.array(n)], names=["word", "beside", "n"])

        held: list = []
        size = 0
        for b in batches:
            for part in pairs(b.column(0)):
                held.append(part)
                size += len(part[0])
                if size > FLUSH:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    return rows.select("text").mapInArrow(run, "word long, beside int, n long").groupBy("word", "beside").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame) -> DataFrame:
    """word long, n long over all texts, end tokens included."""

    def pairs(column: pa.Array) -> Iterator[tuple]:
        for _, _, word, _, _ in hashed(column):
            one, n = np.unique(word, return_counts=True)
            yield one, np.zeros(len(one), np.int64), n

    return _counted(docs, pairs).select("word", "n")


class Types:
    """Hash -> type: 0 the end, then head words, then endings."""

    def __init__(self, head: np.ndarray):
        self.order = np.argsort(head)
        self.head, self.first = head[self.order], 1 + len(head)

    def __len__(self) -> int:
        return self.first + ENDINGS

    def of(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = self.first + ending
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, word), len(self.head) - 1)
            out = np.where(self.head[at] == word, 1 + self.order[at], out)
        out[word == END] = 0
        return out


def class_count(vocab: int) -> int:
    return max(CLASSES, int(np.ceil(vocab**GROWTH)))


def contexts(docs: DataFrame, held, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(types, classes) counts of the class before and after each type."""
    wide, total = int(classes[0]) + 1, len(held.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = held.value
        left, right = np.zeros(total * wide, np.int64), np.zeros(total * wide, np.int64)
        for b in batches:
            for _, _, word, ending, _ in hashed(b.column(0)):
                t = np.concatenate([[0], types.of(word, ending)])
                c = classes[t]
                left += np.bincount(t[1:] * wide + c[:-1], minlength=total * wide)
                right += np.bincount(t[:-1] * wide + c[1:], minlength=total * wide)
        both = np.stack([left.reshape(total, wide), right.reshape(total, wide)], axis=1)
        for lo in range(0, total, BLOCK):
            part = both[lo : lo + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["lo", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in frame.counts)
        return pd.DataFrame({"lo": frame.lo.iloc[:1], "counts": [out.tobytes()]})

    parts = docs.select("text").mapInArrow(run, "lo int, counts binary")
    out = np.zeros((total, 2, wide), np.int64)
    for lo, counts in parts.groupBy("lo").applyInPandas(add, "lo int, counts binary").toPandas().itertuples(index=False):
        part = np.frombuffer(counts, np.int64).reshape(-1, 2, wide)
        out[lo : lo + len(part)] = part
    return out[:, 0], out[:, 1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, classes: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Move types, most frequent first, to the class of highest likelihood given
    the contexts. Type 0 keeps the last class for itself."""
    ctx = np.concatenate([left, right], axis=1).astype(float)
    weight = ctx.sum(axis=1)
    classes = classes.copy()
    sums = np.zeros((classes[0], ctx.shape[1]))
    np.add.at(sums, classes[1:], ctx[1:])
    mass = sums.sum(axis=1)
    for _ in range(sweeps):
        moved = 0
        for w in 1 + np.argsort(-weight[1:], kind="stable"):
            if not weight[w]:
                break
            a = classes[w]
            sums[a] -= ctx[w]
            mass[a] -= weight[w]
            at = np.flatnonzero(ctx[w])
            own = sums[:, at]
            gain = (_xlogx(own + ctx[w, at]) - _xlogx(own)).sum(axis=1) - (_xlogx(mass + weight[w]) - _xlogx(mass))
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            classes[w] = b
            sums[b] += ctx[w]
            mass[b] += weight[w]
            moved += b != a
        if not moved:
            break
    return classes


def best_classes(word: np.ndarray, beside: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For runs of (word, beside, n) the class to which the counts add most
    likelihood. A class of no counts would take every word, so it takes none.
    ``word`` numbers the words from 0."""
    by_context, mass = np.ascontiguousarray(sums.T), sums.sum(axis=1)
    count = int(word[-1]) + 1 if len(word) else 0
    gain, weight, kept = np.zeros((count, len(sums))), np.bincount(word, n, count), _xlogx(by_context)
    for lo in range(0, len(word), 20_000):
        w, j, x = word[lo : lo + 20_000], beside[lo : lo + 20_000], n[lo : lo + 20_000, None]
        more = _xlogx(by_context[j] + x) - kept[j]
        begin = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[begin]] += np.add.reduceat(more, begin)
    gain -= _xlogx(mass + weight[:, None]) - _xlogx(mass)
    return np.where(mass > 0, gain, -np.inf).argmax(axis=1)


def place_words(learned: DataFrame, held, classes: np.ndarray, sums: np.ndarray) -> DataFrame:
    """word, c: the class of each training word that is no type of its own."""
    wide, spark = int(classes[0]) + 1, learned.sparkSession
    fitted = spark.sparkContext.broadcast(sums)

    def pairs(column: pa.Array) -> Iterator[tuple]:
        types = held.value
        for _, _, word, ending, _ in hashed(column):
            t = types.of(word, ending)
            c = np.concatenate([[wide - 1], classes[t], [wide - 1]])
            at = np.flatnonzero(t >= types.first)
            yield _summed([(word[at], c[at], np.ones(len(at))), (word[at], wide + c[at + 2], np.ones(len(at)))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, pair = b.column(1), b.column(1).flatten()
            size = np.diff(lists.offsets.to_numpy())
            found = best_classes(np.repeat(np.arange(len(size)), size), pair.field("beside").to_numpy(), pair.field("n").to_numpy(), fitted.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.astype(np.int32))], names=["word", "c"])

    counted = _counted(learned, pairs)
    return counted.groupBy("word").agg(F.collect_list(F.struct("beside", "n")).alias("beside")).mapInArrow(place, "word long, c int")


class Lookup:
    """Hash -> (n, class) of sorted hashes; n is 0 where there is none."""

    def __init__(self, word: np.ndarray, n: np.ndarray, c: np.ndarray):
        order = np.argsort(word)
        self.word, self.n, self.c = word[order], n[order], c[order]

    def of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.word):
            return np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        hit = self.word[at] == word
        return np.where(hit, self.n[at], 0), np.where(hit, self.c[at], 0)


def _moves(paths: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, where rows begin) of lists of classes."""
    c, begin = paths.flatten().to_numpy(), paths.offsets.to_numpy()
    begin = begin - begin[0]
    before = np.concatenate([[start], c[:-1]]) if len(c) else c
    before[begin[:-1]] = start
    return before, c, begin


def class_scores(docs: DataFrame, train) -> DataFrame:
    """Score all rows of docs (doc_id, text); ``train`` is a condition.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~train).alias("held_out"))
    learned = rows.where("not held_out")
    counts = cut(count_words(learned), "lm-counts")
    total, vocab = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = F.col("n") >= total / 2**COMMON_SHIFT
    got = counts.where(F.col("n") >= total / 2**HEAD_SHIFT).toArrow()
    word, n = got["word"].to_numpy().view(U), got["n"].to_numpy()
    head = word[np.lexsort((word, -n))]
    head = head[head != END]
    held = spark.sparkContext.broadcast(Types(head))
    size, many = len(held.value), class_count(vocab)
    classes = np.arange(size) % many
    classes[0] = many
    for _ in range(PASSES):
        classes = exchange(*contexts(learned, held, classes), classes)
    left, right = contexts(learned, held, classes)
    sums = np.zeros((many, 2 * (many + 1)))
    #: endings mix words of different use; they count only where no word is frequent
    fit = slice(1, 1 + len(head) if len(head) else size)
    np.add.at(sums, classes[fit], np.concatenate([left, right], axis=1)[fit])

    own = spark.createDataFrame(
        pa.table({"word": pa.array(np.append(head, END).view(np.int64)), "c": pa.array(np.append(classes[1 : 1 + len(head)], many).astype(np.int32))}))
    known = cut(counts.join(place_words(learned, held, classes, sums).unionByName(own).hint("merge"), "word"), "lm-words")
    tokens, types = np.zeros(many + 1), np.zeros(many + 1)
    for x in known.groupBy("c").agg(F.sum("n").alias("t"), F.count("*").alias("w")).collect():
        tokens[x.c], types[x.c] = x.t, x.w
    got = known.where(often).toArrow()
    lookup = spark.sparkContext.broadcast(Lookup(got["word"].to_numpy().view(U), got["n"].to_numpy(), got["c"].to_numpy()))

    keyed = rows.select(F.col("doc_id").cast("long"), "text", "held_out", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = lookup.value
        for b in batches:
            own = b.column(1).to_numpy()
            for a, _, word, _, begin in hashed(b.column(0)):
                rare = np.flatnonzero((frequent.of(word)[0] == 0) & (word != END))
                w, h = word[rare], own[a + np.searchsorted(begin, rare, "right") - 1]
                _, at = np.unique(mix(w + mix(h.view(U))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(w[at].view(np.int64))], names=["h", "word"])

    #: dealt by word once: for the distinct rows and for the join
    met = keyed.select("text", "h").mapInArrow(rare_words, "h long, word long").repartition("word").distinct().join(known.where(~often).hint("merge"), "word")
    lists = met.groupBy("h").agg(F.collect_list(F.struct("word", "n", "c")).alias("rare"))
    log_base = np.log10(total + vocab + 1)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, frequent = held.value.first, lookup.value
        for b in batches:
            rare = b.column(3).fill_null([]) if b.column(3).null_count else b.column(3)
            cuts = rare.offsets.to_numpy()
            cuts, pair = cuts - cuts[0], rare.flatten()
            their = [pair.field(k).to_numpy() for k in ("word", "n", "c")]
            for a, z, word, ending, begin in hashed(b.column(1)):
                of_row = np.repeat(np.arange(z - a), np.diff(begin))
                n, c = frequent.of(word)
                #: a row's own list, by hashes of the word and the row
                w, m, k = (x[cuts[a] : cuts[z]] for x in their)
                salt = mix(np.arange(1, z - a + 1, dtype=U))
                mine = Lookup(mix(w.view(U) + np.repeat(salt, np.diff(cuts[a : z + 1]))), m, k)
                m, k = mine.of(mix(word + salt[of_row]))
                c = np.where(n > 0, c, np.where(m > 0, k, classes[first + ending]))
                c[word == END] = many
                n = np.where(n > 0, n, m)
                add = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: B023, E731  every row has its end token
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(np.diff(begin)), pa.array(add((n > 0).astype(np.int64))),
                    pa.array(add(np.log10(n + 1.0)) - np.diff(begin) * log_base), pa.array(add(np.log10(n + DELTA))),
                    pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(c.astype(np.int32))),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "path"])

    paths = cut(
        keyed.join(lists.hint("merge"), "h", "left").select("doc_id", "text", "held_out", "rare")
        .mapInArrow(follow, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, path array<int>"),
        "lm-paths",
    )

    def add_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((many + 1) ** 2, np.int64)
        for b in batches:
            before, c, _ = _moves(b.column(0), many)
            seen += np.bincount(before * (many + 1) + c, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["step", "n"])

    moves = np.zeros((many + 1) ** 2)
    for x in paths.where("not held_out").select("path").mapInArrow(add_moves, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        moves[x.step] = x.n
    moves = moves.reshape(many + 1, many + 1)
    share = (moves.sum(axis=0) + 1) / (moves.sum() + many + 1)
    step = np.log10((moves + KAPPA * share) / (moves.sum(axis=1, keepdims=True) + KAPPA))
    log_room = np.log10(tokens + DELTA * (types + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, c, begin = _moves(b.column(5), many)
            moved = np.add.reduceat(step[before, c] - log_room[c], begin[:-1]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(b.column(6).to_numpy() + moved)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = paths.select("doc_id", "held_out", "n_tokens", "n_known", F.col("base").alias("base_score"), "path", "emit").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
