"""Spelling variants: words one inserted, deleted or replaced letter apart.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z as a-z, so a letter is a
byte of Latin-1 and byte order is code-point order.

1. words are counted where they are read, then summed;
2. words in order become compact tries of SHARD words each: arrays of labels,
   of children and of words' ends, level by level, with the words' counts;
3. tries are broadcast in rounds of at most ROUND bytes. In a round every word's
   distance-one Levenshtein automaton is intersected with every trie of the
   round, depth first: the words of a block walk together, a stack holds the
   blocks of states still to go on. A state is a word's place, a node, and
   whether the edit is spent. Of edits that give the same neighbour (a letter of
   a run of equal letters) only the first in the run is made, so no neighbour is
   emitted twice;
4. neighbours are reduced where they are found to their number and the best one,
   then over rounds;
5. chains of forms are followed by doubling pointers: counts at least double
   with each step, so there are few rounds.

Defined results: null and empty texts and a null doc_id (written as nothing in
front of the colon) add what their letters say; rows that repeat count as often
as they stand; equal counts are settled by the words' order; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard
from .grouped import map_arrow
from .text import strings

LETTERS, UPPER = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LETTERS, LEAST, DROP = 5, 3, 97
SHARD, ROUND, BLOCK = 1 << 15, 32 << 20, 1 << 14


def lowered(word: Column) -> Column:
    """A-Z as a-z; letters beyond ASCII stay."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def misspelt(doc_id: Column, word: Column, drop: int = DROP) -> Column:
    """``word`` without a letter where ``drop`` divides the CRC-32 of
    ``<doc_id>:<word>``, else as it is."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(drop)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST, drop: int = DROP) -> DataFrame:
    """word, n of all words of ``letters`` letters that occur ``least`` times,
    after :func:`misspelt`."""
    #: shorter runs give shorter words only
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))).alias("run"))
    words = runs.select(F.col("doc_id"), lowered(F.col("run")).alias("run")).select(misspelt(F.col("doc_id"), F.col("run"), drop).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie of sorted words; nodes are numbered level by level, so that a
    node's children are neighbours in the order of their labels."""

    def __init__(self, data: np.ndarray, off: np.ndarray, counts: np.ndarray):
        self.data, self.off, self.counts = data, off, counts
        size = np.diff(off)
        node, active, depth = np.zeros(len(size), np.int64), np.arange(len(size)), 0
        parents, labels, total = [np.zeros(1, np.int64)], [np.zeros(1, np.uint8)], 1
        while True:
            active = active[size[active] > depth]
            if not len(active):
                break
            code = node[active] << 8 | data[off[active] + depth]
            new = np.concatenate([[True], code[1:] != code[:-1]])
            node[active] = total + np.cumsum(new) - 1
            parents.append(code[new] >> 8)
            labels.append((code[new] & 255).astype(np.uint8))
            total += int(new.sum())
            depth += 1
        self.label = np.concatenate(labels)
        self.last = node.astype(np.int32)
        children = np.bincount(np.concatenate(parents[1:]), minlength=total) if total > 1 else np.zeros(1, np.int64)
        self.children = children.astype(np.uint8)
        self._index()

    def _index(self) -> None:
        size = self.children.astype(np.int64)
        #: node k's children are first[k], first[k] + 1 ...
        self.first = (np.cumsum(size) - size + 1).astype(np.int32)
        self.keys = np.repeat(np.arange(len(size), dtype=np.int64) << 8, size) | self.label[1:]
        self.end = np.full(len(size), -1, np.int32)
        self.end[self.last] = np.arange(len(self.last))

    def pack(self) -> bytes:
        sizes = np.array([len(self.counts), len(self.label), len(self.data)], np.int64)
        parts = (sizes, self.counts.astype(np.int64), self.last, np.diff(self.off).astype(np.int32), self.children, self.label, self.data)
        return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        self, at = cls.__new__(cls), 24
        words, nodes, size = np.frombuffer(raw, np.int64, 3).tolist()

        def part(dtype, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        self.counts, self.last = part(np.int64, words), part(np.int32, words)
        self.off = np.concatenate([[0], np.cumsum(part(np.int32, words), dtype=np.int64)])
        self.children, self.label, self.data = part(np.uint8, nodes), part(np.uint8, nodes), part(np.uint8, size)
        self._index()
        return self

    def word(self, k: int) -> str:
        return self.data[self.off[k] : self.off[k + 1]].tobytes().decode("latin-1")

    def child(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each node under a label, 0 if there is none."""
        if not len(self.keys):
            return np.zeros(len(node), np.int32)
        key = node.astype(np.int64) << 8 | label
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0).astype(np.int32)


def neighbours(trie: Trie, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, word of the trie) of all that are one edit apart.

    Depth first over blocks of states: a block before the edit has all words at
    one place; after it a word just follows the labels.
    """
    size = np.diff(off)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    start = np.arange(len(size), dtype=np.int32)
    stack: list[tuple] = [(False, start, np.zeros(len(size), np.int32), 0)]
    while stack:
        spent, word, node, at = stack.pop()
        if spent:
            whole = at == size[word]
            found = trie.end[node[whole]]
            out.append((word[whole][found >= 0], found[found >= 0]))
            word, node, at = word[~whole], node[~whole], at[~whole]
            nxt = trie.child(node, data[off[word] + at])
            on = nxt > 0
            if on.any():
                stack.append((True, word[on], nxt[on], at[on] + 1))
            continue
        inside = size[word] > at
        own = np.where(inside, data[np.minimum(off[word] + at, len(data) - 1)], 0)
        before = data[off[word] + at - 1] if at else np.zeros(len(word), np.uint8)
        cut_out = inside & (own != before)
        many = trie.children[node].astype(np.int64)
        each = np.repeat(np.arange(len(word)), many)
        child = (np.repeat(trie.first[node] - (np.cumsum(many) - many), many) + np.arange(len(each))).astype(np.int32)
        label = trie.label[child]
        put_in = label != before[each]
        same = inside[each] & (label == own[each])
        put_for = inside[each] & ~same
        heads = [word[cut_out], word[each[put_in]], word[each[put_for]]]
        nodes = [node[cut_out], child[put_in], child[put_for]]
        ats = [np.full(len(h), a, np.int32) for h, a in zip(heads, (at + 1, at, at + 1), strict=True)]
        if same.any():
            stack.append((False, word[each[same]], child[same], at + 1))
        stack.append((True, np.concatenate(heads), np.concatenate(nodes), np.concatenate(ats)))
    return np.concatenate([x[0] for x in out]) if out else start[:0], np.concatenate([x[1] for x in out]) if out else start[:0]


def tries(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """first string, bytes long, trie binary: sorted (word, n) as packed tries of
    ``shard`` words, apart in the words' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []

        def flush() -> pa.RecordBatch:
            texts, counts = zip(*held, strict=True)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            blob = Trie(np.frombuffer(b"".join(texts), np.uint8), off, np.array(counts, np.int64)).pack()
            held.clear()
            return pa.RecordBatch.from_pydict({"first": [texts[0].decode("latin-1")], "bytes": [len(blob)], "trie": pa.array([blob], pa.binary())})

        for b in batches:
            for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((text.encode("latin-1"), n))
                if len(held) == shard:
                    yield flush()
        if held:
            yield flush()

    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return ordered.transform(map_arrow, run, "first string, bytes long, trie binary")


def _intersect(held):
    """word, n, n_near, form_n, form of the words of packed tries, within the
    tries of a round; the tries are in the words' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                own = Trie.unpack(blob)
                n = len(own.counts)
                near, best, form = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, None, object)
                for other in map(Trie.unpack, held.value):
                    for a in range(0, n, BLOCK):
                        z = min(a + BLOCK, n)
                        word, found = neighbours(other, own.data[own.off[a] : own.off[z]], own.off[a : z + 1] - own.off[a])
                        near[a:z] += np.bincount(word, minlength=z - a)
                        order = np.lexsort((found, -other.counts[found], word))
                        word, found = word[order] + a, found[order]
                        lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else order
                        lead = lead[other.counts[found[lead]] > best[word[lead]]]
                        best[word[lead]] = other.counts[found[lead]]
                        form[word[lead]] = [other.word(k) for k in found[lead].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([own.word(k) for k in range(n)]), pa.array(own.counts), pa.array(near), pa.array(best), pa.array(form, pa.string())], names=["word", "n", "n_near", "form_n", "form"])

    return run


def near_words(words: DataFrame, shard: int = SHARD, most: int = ROUND) -> DataFrame:
    """word, n, n_near, best_n, best: of each of (word, n) the number of words
    one edit apart and the one of them with the largest n, the first in order
    among equals."""
    spark = words.sparkSession
    shards = cut(tries(words, shard), "tries")
    #: a row for each SHARD words of the vocabulary
    sizes = shards.orderBy("first").select("first", "bytes").collect()
    rounds: list[list[str]] = []
    room = 0
    for first, size in sizes:
        if not rounds or size > room:
            rounds.append([])
            room = most
        rounds[-1].append(first)
        room -= size
    asked = shards.repartition(max(1, 3 * len(sizes)), "first").select("trie")
    parts = []
    for own in rounds:
        tables = shards.where(F.col("first").between(own[0], own[-1])).orderBy("first").select("trie").toArrow()["trie"].to_pylist()
        held = spark.sparkContext.broadcast(tables)
        parts.append(cut(asked.transform(map_arrow, _intersect(held), "word string, n long, n_near long, form_n long, form string"), "near"))
        held.destroy()
    discard(shards)
    if not parts:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    #: the least of (-n, word) is the best
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("word"))))
    out = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.word").alias("best"))


def last_of_chains(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms from each
    word, by pointers that double. Chains must end."""
    now = cut(links.select("word", F.col("form").alias("root")), "chain")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = cut(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "chain")
        discard(now)
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST, drop: int = DROP, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words: ``form`` is the near word
    of the largest count, if that is ``factor`` times the word's own."""
    words = cut(word_counts(docs, letters, least, drop), "words")
    near = near_words(words)
    frequent = F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))
    found = cut(near.select("word", F.when(frequent, F.col("best")).alias("form"), "n", "n_near", F.when(frequent, F.col("best_n")).alias("form_n")), "variants")
    discard(words)
    roots = last_of_chains(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
