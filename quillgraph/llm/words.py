"""Words of Arrow text columns as arrays of 64-bit hashes, for use inside Spark tasks.

A word is a maximal run of bytes other than the six ASCII blanks (0x20, 0x09-0x0D). Hashes are polynomial prefix hashes over
randomly mapped bytes, finished with a mixer: a pass of array operations per text, no Python object per word.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
GROUP_BYTES = 1 << 22
STEP_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_BASE))


_PLAIN = random_words(256, 7)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown when a single word needs more."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        _powers = out[0], out[1]
    return _powers


class Words(NamedTuple):
    """Words of consecutive rows; firsts[r]:firsts[r + 1] are those of row r."""
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    data: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.firsts) - 1, dtype=np.int64), np.diff(self.firsts))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the column and the offsets of its rows; a null row is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def _edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of each word; words end where a row does."""
    inside = ~_BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def words_of(data: np.ndarray, bounds: np.ndarray, fold: bool) -> Words:
    """Hashes every word of the rows. Work is cut at word starts, so the extra memory depends on the longest word only."""
    starts, ends = _edges(data, bounds) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = np.empty(len(starts), np.uint64)
    table = _FOLDED if fold else _PLAIN
    at = 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP_BYTES)))
        left, right = int(starts[at]), int(ends[until - 1])
        power, inverse = _power_tables(right - left + 1)
        sums = np.zeros(right - left + 1, np.uint64)
        np.cumsum(table[data[left:right]] * power[:right - left], out=sums[1:])
        a, b = starts[at:until] - left, ends[at:until] - left
        hashes[at:until] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        at = until
    return Words(hashes, starts, ends, np.searchsorted(starts, bounds), data)


def word_groups(column: pa.Array, fold: bool = True, most: int = GROUP_BYTES) -> Iterator[tuple[int, Words]]:
    """(first row, words) for runs of rows of about ``most`` bytes; a longer row comes alone."""
    data, bounds = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, words_of(data[bounds[row]:bounds[last]], bounds[row:last + 1] - bounds[row], fold)
        row = last


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and their bounds by row. A row with fewer words has its whole sequence."""
    lengths = np.diff(words.firsts)
    factors = random_words(size, 11)
    h = words.hashes
    runs = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        runs += (h[k:k + len(runs)] ^ factors[k]) * (factors[k] | np.uint64(1))
    runs = mix(runs)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(bounds[-1]), np.uint64)
    row = np.repeat(np.arange(len(lengths)), counts)
    at = words.firsts[row] + (np.arange(len(out)) - bounds[row])
    full = lengths[row] >= size
    out[full] = runs[at[full]]
    for j in np.flatnonzero(~full):
        own = h[words.firsts[row[j]]:words.firsts[row[j] + 1]]
        out[j] = mix(np.array([np.sum((own ^ factors[:len(own)]) * (factors[:len(own)] | np.uint64(1))) + np.uint64(len(own))], np.uint64))[0]
    return out, bounds
