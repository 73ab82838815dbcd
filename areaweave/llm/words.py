"""Words and their hashes for whole batches of texts at once, as flat numpy arrays.

A word is a maximal run of bytes other than space and the controls 9 to 13, which is
``[^\\x20\\x09-\\x0D]+`` on UTF-8.  Everything here works on batches of a bounded number
of bytes, so that memory in a task does not grow with the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Bases of the rolling window hashes; two different ones give independent hashes.
ROLL_A, ROLL_B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes of text in a batch.
BLOCK = 2 << 20


class Words(NamedTuple):
    """All words of a batch of texts in order.

    data: the bytes of all texts; start, end: each word's place in data;
    first: for each text, the index of its first word (one entry more than texts).
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        """The bytes of word i."""
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes in ``column`` (or one row).

    After the last one the worker, which Spark keeps for later tasks, gives back what it does not use.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.concatenate([[0], np.cumsum(size[:-1])]) // most
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offset of each text (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    data = np.frombuffer("".join(texts.to_pylist()).encode("utf-8"), np.uint8)
    return data, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of every text; ``lower`` turns A-Z, and nothing else, into a-z."""
    data, offset = flat(texts)
    if lower:
        data = lowered(data)
    return split_bytes(data, offset)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z, and nothing else, turned into a-z."""
    return _LOWER[data]


def split_bytes(data: np.ndarray, offset: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """The words of the texts that lie one after the other in ``data``; ``between`` has the bytes that part them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offset), np.int64))
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offset] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offset))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The modulus of the rolling hashes, a prime, and the length from which a word is hashed by itself.
PRIME, LONG = (1 << 61) - 1, 64
_P = np.uint64(PRIME)
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 64 modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of numbers below PRIME, modulo PRIME."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    upper = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _folded((a1 * b1 << np.uint64(1)) + upper + a0 * b0)


@lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, _times(out, np.uint64(pow(base, len(out), PRIME)))])
    return out


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME of numbers below it, with a zero in front."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    out = np.zeros(len(values) + 1, np.uint64)
    upper = np.cumsum(values >> half, dtype=np.uint64)
    lower = np.cumsum(values & low, dtype=np.uint64)
    out[1:] = _folded((upper >> np.uint64(30)) + ((upper & np.uint64((1 << 30) - 1)) << half) + lower)
    return out


def _rolled(values: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Sum of values[i] * base ** (i - a) over a <= i < b, modulo PRIME, for each (a, b)."""
    base %= PRIME
    size = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(base, size), _powers(pow(base, -1, PRIME), size)
    total = _sums(_times(_folded(values), up[: len(values)]))
    return _times(_folded(total[b] + (_P - total[a])), down[a])


def _padded(data: np.ndarray) -> np.ndarray:
    """For each place of ``data``, the eight bytes from there on as one number."""
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", whole, strides=(1,))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time, mixed after each, so that no pattern cancels out."""
    size = words.end - words.start
    out = mix(size.astype(np.uint64) + np.uint64(_BASE))
    eight = _padded(words.data)
    row, at = np.flatnonzero(size < LONG), 0
    while len(row):
        left = size[row] - at
        row, left = row[left > 0], left[left > 0]
        out[row] = mix(out[row] ^ (eight[words.start[row] + at] & _TAILS[np.minimum(left, 8)]))
        at += 8
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(blake2b(words.data[words.start[i] : words.end[i]], digest_size=8).digest(), "little")
    return out


def differ(words: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words i and j are not the same bytes."""
    size = words.end - words.start
    out = size[i] != size[j]
    eight = _padded(words.data)
    row, at = np.flatnonzero(~out & (i != j) & (size[i] < LONG)), 0
    while len(row):
        left = size[i[row]] - at
        row, left = row[left > 0], left[left > 0]
        a, b = eight[words.start[i[row]] + at], eight[words.start[j[row]] + at]
        out[row] |= (a ^ b) & _TAILS[np.minimum(left, 8)] != 0
        at += 8
    for k in np.flatnonzero(~out & (i != j) & (size[i] >= LONG)).tolist():
        out[k] = words.text(i[k]) != words.text(j[k])
    return out


def window_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo PRIME, of each run of ``width`` words; the i-th starts at word i.

    Windows across the end of a text are among them: see ``window_starts``.
    """
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - width + 1)
    return mix(_rolled(hashes, at, at + width, base))


def window_starts(words: Words, width: int) -> np.ndarray:
    """The word indexes at which a window of ``width`` words lies within one text."""
    count = np.diff(words.first)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text))
    return np.flatnonzero(at + width <= words.first[1:][text]) if len(text) else at
