"""Vectorised words and word hashes over the UTF-8 bytes of Arrow string columns.

White space separates words (bytes 0x20 and 0x09-0x0D), so a word is the same in bytes and in
code points. Word hashes are 64-bit: a polynomial over random byte values, then a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_VALUE = _VALUE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tables[0], tables[1]
    return _powers[size]


def string_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; null is empty.

    A text is never cut: a longer one is a run of its own.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin (one more entry than texts)."""
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower`` A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER_VALUE if lower else _VALUE)[data] * power[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _BASE)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles, text after text, and where each text's begin.

    A text of fewer than ``size`` words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out_counts, out=begin[1:])
    out = np.empty(begin[-1], np.uint64)
    long = np.flatnonzero(counts >= size)
    if len(long):
        windows = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            windows += words[k : k + len(windows)] * _PLACE[k]
        windows = mix(windows)
        where = np.zeros(len(words) + 1, np.int32)
        np.add.at(where, first[long], 1)
        np.add.at(where, first[long + 1] - size + 1, -1)
        target = np.zeros(len(out) + 1, np.int32)
        np.add.at(target, begin[long], 1)
        np.add.at(target, begin[long + 1], -1)
        out[np.cumsum(target[:-1]) > 0] = windows[np.cumsum(where[:-1])[: len(windows)] > 0]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[first[i] : first[i + 1]]
        out[begin[i]] = mix((w * _PLACE[32 : 32 + len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))[0]
    return out, begin
