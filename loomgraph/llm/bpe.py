"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of its bytes. Every adjacent pair that the rank
file knows waits in the bucket of its rank; two levels of 256-bit words mark the
buckets that hold something, so find-first-set on two words gives the next
rank, whatever the length. Entries whose pair has changed since are
skipped when they come up. A pre-token of n bytes takes O(n) queue steps, with
no rescans: megabytes without a space are no special case.

Within a bucket positions come up leftmost first, which is the order of merges
that rank files are defined by. A pre-token that is itself in the file is one
token. Pre-tokens repeat, so a bounded cache keeps their ids.

Defined results: a null text is the empty text: 0 tokens; repeated rows are
encoded each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .grouped import keep, map_arrow

#: pre-tokens of a generation that a process remembers; results don't depend on it
CACHE = 400_000


class _Pieces(dict):
    """Ids of pre-tokens, of two generations: a full one becomes the older one,
    whose entries come back when they are met again."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece) or self.encode(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for a rank file (base64 token, space, rank a line)."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(k) for k in range(size)]
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.encode_piece, cache)
        self._low, self._buckets = [0] * ((size >> 8) + 1), {}

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        get, low, buckets, top, n = ranks.get, self._low, self._buckets, 0, len(piece)
        after, before, rank = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                rank[i] = r
                if r in buckets:
                    buckets[r].append(i)  # positions ascend
                else:
                    buckets[r] = [i]
                    b = r >> 8
                    low[b] |= 1 << (r & 255)
                    top |= 1 << b
        while top:
            b = (top & -top).bit_length() - 1
            word = low[b]
            r = b << 8 | (word & -word).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                word &= word - 1
                low[b] = word
                if not word:
                    top &= top - 1
            if rank[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            rank[j] = rank[i] = -1
            after[i] = k
            before[k] = i
            if k < n and (new := get(piece[i : after[k]])) is not None:
                rank[i] = new
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    b = new >> 8
                    low[b] |= 1 << (new & 255)
                    top |= 1 << b
            p = before[i]
            if p >= 0:
                new = get(piece[p:k])
                if new is None:
                    rank[p] = -1
                else:
                    rank[p] = new
                    if new in buckets:
                        heappush(buckets[new], p)
                    else:
                        buckets[new] = [p]
                        b = new >> 8
                        low[b] |= 1 << (new & 255)
                        top |= 1 << b
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(ranks[piece[i:k]])
            i = k
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; strings of special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of token ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


def tokenizer(path: str, pattern: str, cache: int = CACHE) -> ByteBpe:
    """One instance a process, as long as its tasks encode."""
    return keep(__name__, (path, pattern, cache), lambda: ByteBpe(path, pattern, cache))


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ids array<int> of every text."""
    names = [*keep, "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return docs.select(*names).transform(map_arrow, run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern, cache)
        for b in batches:
            counts, ids_hex, decoded_hex = [], [], []
            for text in b.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                decoded_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(map_arrow, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
