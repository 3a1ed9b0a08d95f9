"""Vectorised byte, word and shingle hashing over Arrow string columns.

Words are the runs of ``[^\\x20\\x09-\\x0D]``; A-Z count as a-z. All hashes are
64-bit and depend on content only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n (modulo 2**64)."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in ((0, _BASE), (1, _BASE_INV)):
            out = np.ones(1, U)
            while len(out) < size:
                out = np.concatenate([out, out * U(pow(base, len(out), 1 << 64))])
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = B**s * hash(data[s:e])."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], from :func:`prefix_hash`."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together, one row at least."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row): all words of a chunk of rows."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = ~_SPACE[data]
    starts = word[:n].copy()
    starts[1:] &= ~word[: n - 1] if n else starts[1:]
    edge = off[(off > 0) & (off < n)]
    starts[edge] |= word[edge]
    ends = word[:n] & ~word[1:]
    ends[edge - 1] |= word[edge - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a chunk, and where each row's begin."""
    low = LOWER[data]
    s, e, first = words(low, off)
    return span_hash(prefix_hash(low), s, e), first


def shingles(word_hash: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each row's begin.

    A row of fewer words has one shingle of all its words; a row without words
    has none.
    """
    n = len(word_hash)
    count = np.diff(first)
    full = np.maximum(count - size + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(full)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], full) + np.repeat(first[:-1], full)
    last = np.repeat(first[1:], full)
    out = np.zeros(len(at), U)
    for k in range(size):
        i = at + k
        inside = i < last
        out += np.where(inside, word_hash[np.minimum(i, max(n - 1, 0))] if n else out, U(0)) * U(pow(_BASE, 2 * k + 1, 1 << 64))
    return mix(out), begin


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first run of each row): maximal runs of the marked bytes of
    a chunk of rows; no run crosses rows."""
    n = len(inside)
    mark = np.zeros(n + 1, bool)
    mark[:n] = inside
    begin = mark[:n].copy()
    begin[1:] &= ~mark[: max(n - 1, 0)]
    end = mark[:n] & ~mark[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] |= mark[edge]
    end[edge - 1] |= mark[edge - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, off)
