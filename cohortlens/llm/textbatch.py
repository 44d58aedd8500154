"""Whole-batch word and shingle hashing for tasks that read text as Arrow.

Everything here works on the UTF-8 bytes of many documents at once, so Python never loops over
words. A word hash is a polynomial over its bytes (differences of one running sum), followed by
a 64-bit finaliser; a shingle hash combines the hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


class WordRule(NamedTuple):
    """Which bytes belong to words, and the number each byte stands for."""

    inside: np.ndarray
    digit: np.ndarray


def _rule(outside: set[int]) -> WordRule:
    byte = np.arange(256)
    inside = np.ones(256, bool)
    inside[list(outside)] = False
    lowered = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return WordRule(inside, (lowered + 1).astype(_U))


#: Words are runs of anything but ASCII white space.
SPACED = _rule({0x20, *range(0x09, 0x0E)})
#: Words are runs of ASCII letters, ASCII digits and all characters beyond ASCII.
ALNUM = _rule({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})

#: Bytes that end a piece of text, and words inside pieces: runs of anything but them, blanks and tabs.
PIECE_ENDS = frozenset({*b".,;:!?", *range(0x0A, 0x0E)})
PIECED = _rule({0x20, 0x09, *PIECE_ENDS})
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, a bijection."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _geometric(ratio: int, size: int) -> np.ndarray:
    steps = np.full(size, ratio, _U)
    steps[0] = 1
    return np.cumprod(steps)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if _powers.size < n:
        size = max(n, _SLICE)
        _powers = _geometric(_BASE, size)
        back = pow(_BASE, -1, 1 << 64)
        _inverses = _geometric(back, size)
    return _powers, _inverses


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so what is copied or derived at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 bounds of its rows; NULL is the empty text."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cuts(buf: np.ndarray, bounds: np.ndarray, rule: WordRule) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < buf.size:
        hi = min(lo + _SLICE, buf.size)
        width = _SLICE
        while hi < buf.size:
            gaps = np.flatnonzero(~rule.inside[buf[lo + 1 : hi + 1]])
            edge = bounds[np.searchsorted(bounds, hi, "right") - 1]
            best = max(lo + 1 + int(gaps[-1]) if gaps.size else lo, int(edge))
            if best > lo:
                hi = best
                break
            width *= 2
            hi = min(lo + width, buf.size)
        yield lo, hi
        lo = hi


class Words(NamedTuple):
    """Words of consecutive rows: byte spans, hashes and, per row, where its words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.first.size - 1), self.counts())


def words(buf: np.ndarray, bounds: np.ndarray, rule: WordRule) -> Words:
    starts, ends, hashes = [], [], []
    for lo, hi in _cuts(buf, bounds, rule):
        b = buf[lo:hi]
        inside = rule.inside[b]
        edges = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo
        before = np.concatenate(([False], inside[:-1]))
        before[edges] = False
        after = np.concatenate((inside[1:], [False]))
        after[edges[edges > 0] - 1] = False
        s = np.flatnonzero(inside & ~before)
        e = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power_tables(b.size + 1)
        run = np.zeros(b.size + 1, _U)
        np.cumsum(rule.digit[b] * power[: b.size], out=run[1:])
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(mix((run[e] - run[s]) * inverse[s]))
    if not starts:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty.astype(_U), np.zeros(len(bounds), np.int64))
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, bounds))


def run_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words inside one row, and the index of its first word."""
    n = w.hash.size - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for j in range(1, k):
        h *= _U(_STEP)
        h += w.hash[j : j + n]
    row = w.row()
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(h[at] ^ _U(k * _BASE & _MASK)), at


def set_hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every row, grouped by row, and the n + 1 bounds of the groups.

    A row of fewer than ``k`` words but at least one gives its whole sequence as one shingle.
    """
    h, at = run_hashes(w, k)
    count = np.maximum(w.counts() - k + 1, 0)
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < k))
    if short.size:
        extra = np.zeros(short.size, _U)
        for length in range(1, k):
            mine = np.flatnonzero(w.counts()[short] == length)
            if mine.size:
                first = w.first[short[mine]]
                acc = w.hash[first].copy()
                for j in range(1, length):
                    acc = acc * _U(_STEP) + w.hash[first + j]
                extra[mine] = mix(acc ^ _U(length * _BASE & _MASK))
        where = np.concatenate(([0], np.cumsum(count)))[short]
        h = np.insert(h, where, extra)
        count[short] = 1
    return h, np.concatenate(([0], np.cumsum(count)))


def distinct_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values inside each group, and the new bounds."""
    parts = [np.unique(h[first[i] : first[i + 1]]) for i in range(first.size - 1)]
    sizes = np.array([p.size for p in parts], np.int64)
    return (np.concatenate(parts) if parts else h), np.concatenate(([0], np.cumsum(sizes)))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def span_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans one after the other, A-Z lowered, and their n + 1 bounds."""
    size = end - start
    bounds = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
    return _LOWER[buf[at]], bounds


def span_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    data, bounds = span_bytes(buf, start, end)
    return pa.Array.from_buffers(pa.large_string(), start.size, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
