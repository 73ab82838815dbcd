"""Encoding of texts through a cache of their units, for tokenizers that never look across white space.

A unit is a run of other characters with the one space before it, or what is left of a run of
white space.  Tokenizers whose split pattern is `` ?\\p{L}+| ?\\p{N}+|...|\\s+(?!\\S)|\\s+`` give
a text the ids of its units one after the other, so each distinct unit is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from areaweave.llm import words as W

#: White space beyond ASCII: U+0085 and U+00A0, and the three-byte ones.
_PAIRS = [(0xC2, 0x85), (0xC2, 0xA0)]
_TRIPLES = [(0xE1, 0x9A, 0x80), (0xE2, 0x81, 0x9F), (0xE3, 0x80, 0x80)] + [
    (0xE2, 0x80, c) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)
]
_ASCII = np.zeros(256, bool)
_ASCII[[9, 10, 11, 12, 13, 32]] = True
#: New units after which a worker forgets those not met since as many before; about 150 bytes each.
CACHED = 300_000


def _space(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _ASCII[data]
    for lead in {p[0] for p in _PAIRS + _TRIPLES}:
        at = np.flatnonzero(data == lead)
        for pattern in (p for p in _PAIRS + _TRIPLES if p[0] == lead):
            fits = at[at + len(pattern) <= len(data)]
            for k, byte in enumerate(pattern):
                fits = fits[data[fits + k] == byte]
            for k in range(len(pattern)):
                out[fits + k] = True
    return out


def cut(data: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all units of the texts that lie one after the other in ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offset] = True
    edge[1:-1] |= space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    blank = space[start]
    text_end = np.zeros(len(data) + 1, bool)
    text_end[offset] = True
    # The last character of white space before a word goes with the word if it is a space.
    inner = blank & ~text_end[end]
    last = data[end - 1]
    size = np.where(last < 0x80, 1, np.where(data[np.maximum(end - 2, 0)] == 0xC2, 2, 3))
    joins = inner & (last == 32)
    word_start = start.copy()
    word_start[1:] -= joins[:-1]
    words = (word_start[~blank], end[~blank])
    rest_end = np.where(inner, end - size, end)[blank]
    rest = (start[blank], rest_end)
    alone = (rest_end[(inner & ~joins)[blank]], end[inner & ~joins])
    start, end = (np.concatenate(x) for x in zip(words, rest, alone, strict=True))
    real = end > start
    order = np.argsort(start[real], kind="stable")
    return start[real][order], end[real][order]


#: Letters (1), digits (2) and other marks (3) of ASCII; the apostrophe and controls have no class.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 0


def cut_classes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units cut again wherever letters, digits and other marks meet.

    Only ASCII and the letters from U+00C0 to U+00FF count, and nothing is cut beside an
    apostrophe, so a split pattern that keeps these three classes apart ends a match at
    each of the cuts.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    mark = np.zeros(len(data) + 1, np.int8)
    mark[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    mark[start] = 1
    begin = np.flatnonzero(mark[:-1])
    # Units cover all bytes, so each piece reaches to where the next one begins.
    return begin, np.concatenate([begin[1:], end[-1:]])


def distinct_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct value, any one, in ascending order of values; and for each row the place in that list.

    ``np.unique`` gives the first row, for which it needs the slower stable sort.
    """
    order = np.argsort(values)
    held = values[order]
    begins = np.ones(len(values), bool)
    begins[1:] = held[1:] != held[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(begins) - 1
    return order[begins], which


class _Store:
    """Units with their ids: one array of all ids, and where those of each unit begin."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._ids, self._used = np.zeros(4096, np.uint32), 0

    def find(self, units: list[bytes]) -> np.ndarray:
        """Place of each unit, -1 if unknown."""
        return np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))

    def add(self, units: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        n, used = len(self.place), self._used
        while n + len(units) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.begin, self.count))
        while used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(len(self._ids), np.uint32)])
        self.begin[n : n + len(units)] = used + np.cumsum(count) - count
        self.count[n : n + len(units)] = count
        self._ids[used : used + len(ids)] = ids
        self._used += len(ids)
        self.place.update(zip(units, range(n, n + len(units)), strict=True))

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units at these places in order, and how many each has."""
        count = self.count[place]
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        return self._ids[np.arange(total) + np.repeat(self.begin[place] - stop + count, count)], count


class Encoder:
    """Ids of texts; ``encode`` turns a list of units into all their ids in order and the number of each.

    Units are told apart by hash and then by their bytes, so no two share ids by accident.
    ``classes`` cuts them where letters, digits and other marks meet.
    """

    def __init__(
        self,
        encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        cached: int = CACHED,
        classes: bool = False,
    ):
        self._encode, self._cached, self._classes = encode, cached, classes
        self._known, self._older = _Store(), _Store()

    def rest(self) -> None:
        """Forget what only a running task gains from."""
        self._older = _Store()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where those of each text begin (one entry more than texts)."""
        data, offset = W.flat(texts)
        start, end = cut(data, offset)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offset), np.int64)
        if self._classes:
            start, end = cut_classes(data, start, end)
        units = W.Words(data, start, end, offset)
        sample, which = distinct_rows(W.word_hashes(units))
        odd = np.flatnonzero(W.differ(units, np.arange(len(which)), sample[which]))
        if len(odd):  # other bytes under the same hash: each stands for itself
            which[odd] = len(sample) + np.arange(len(odd))
            sample = np.concatenate([sample, odd])
        raw = data.tobytes()
        distinct = [raw[a:b] for a, b in zip(start[sample].tolist(), end[sample].tolist(), strict=True)]
        if len(self._known.place) > self._cached:
            self._known, self._older = _Store(), self._known
        known, older = self._known, self._older
        place = known.find(distinct)
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            missing = list(dict.fromkeys(distinct[i] for i in missing))
            before = older.find(missing)
            met = np.flatnonzero(before >= 0)
            known.add([missing[i] for i in met.tolist()], *older.ids(before[met]))
            new = [missing[i] for i in np.flatnonzero(before < 0).tolist()]
            if new:
                known.add(new, *self._encode(new))
            unknown = np.flatnonzero(place < 0)
            place[unknown] = known.find([distinct[i] for i in unknown.tolist()])
        ids, count = known.ids(place[which])
        return ids, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, offset)]
