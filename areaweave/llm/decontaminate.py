"""Benchmark decontamination: documents that hold an item of a benchmark, give or take edits.

Method: the CGK random walk embeds a sequence of words so that a small edit distance becomes
a small Hamming distance: at step t the word under the pointer is put out, and a random bit of
(t, word) moves the pointer on or not.  Repeated bit sampling hashes a few of the put-out words to
a key; SAMPLES of them, WALKS x TABLES times, reach the target recall.  Windows of the size of
an item whose key equals one of the item's are checked exactly, word by word.

Windows that cannot match are not embedded.  An edit spoils at most GRAM of the n - GRAM + 1 runs
of GRAM words that the text shares with an item of n words, so a window must hold the rest
of them; this loses nothing.

The allowed edits grow with the item and the walk drifts with each of them, so fixed numbers of
walks and tables hold the recall for short items only.  Longer items are embedded in pieces of at most
WALKED words: with n // EDIT_WORDS edits in all, some piece has no more than its own share of
them, and it meets a key as an item of its size does.  Where a piece does, the whole item is compared
exactly with the text around, in bit-parallel steps.

An item of n words matches where it fits with at most n // EDIT_WORDS edited words.
Items of fewer than GRAM words may have no edit and are looked for word by word.  Benchmarks of any
size are looked for in blocks of items of bounded size, one after the other; each block is one pass over
the documents, which are never shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import table, written
from areaweave.operators.scale import shared_folder

GRAM, EDIT_WORDS = 3, 6
#: With these, windows of up to WALKED words at the largest allowed distance are found with a
#: probability of 0.95 or more; longer items are embedded in pieces.
WALKS, TABLES, SAMPLES = 8, 6, 3
WALKED = 36
#: Bytes of the items of one block; about 15 times as many in every task.
BLOCK_BYTES = 3 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def allowed(n: int) -> int:
    """Edits that an item of n words may have."""
    return n // EDIT_WORDS


def _embedded(windows: np.ndarray) -> np.ndarray:
    """CGK: for each row of words (0 pads) and walk, the words put out in 2 n steps."""
    rows, n = windows.shape
    padded = np.column_stack([windows, np.zeros(rows, np.uint64)]).ravel()
    out = np.empty((2 * n, rows, WALKS), np.uint64)
    row = np.repeat(np.arange(rows) * (n + 1), WALKS).reshape(rows, WALKS)
    at, end = row.copy(), row + n
    salts = W.mix(np.arange(2 * n * WALKS, dtype=np.uint64) + np.uint64(1)).reshape(2 * n, WALKS)
    for t in range(2 * n):
        word = padded[at]
        out[t] = word
        at += ((word ^ salts[t]) * _ODD >> np.uint64(63)).astype(np.int64)
        np.minimum(at, end, out=at)
    return out


@lru_cache(512)
def _places(n: int) -> np.ndarray:
    """Steps that each table of each walk samples, for windows of n words."""
    choose = np.random.default_rng(n)
    few = min(SAMPLES, 2 * n)
    return np.array([[np.sort(choose.choice(2 * n, few, replace=False)) for _ in range(TABLES)] for _ in range(WALKS)])


def keys(windows: np.ndarray) -> np.ndarray:
    """The WALKS x TABLES keys of each row of words; rows of different sizes never agree."""
    rows, n = windows.shape
    image, places = _embedded(windows), _places(n)
    walk = np.arange(WALKS)[:, None]
    key = W.mix(np.uint64(n * 1009) + np.arange(WALKS * TABLES, dtype=np.uint64)).reshape(1, WALKS, TABLES)
    for k in range(places.shape[2]):
        key = W.mix(key + image[places[:, :, k], :, walk].transpose(2, 0, 1))
    return key.reshape(rows, -1)


def fit(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and a part of the text, and that part's start and stop."""
    m = len(text)
    row, begin = [0] * (m + 1), list(range(m + 1))
    words = text.tolist()
    for i, own in enumerate(item.tolist(), 1):
        last, last_begin = row, begin
        row, begin = [i], [0]
        for j, word in enumerate(words):
            best, start = last[j] + (own != word), last_begin[j]
            if last[j + 1] + 1 < best:
                best, start = last[j + 1] + 1, last_begin[j + 1]
            if row[j] + 1 < best:
                best, start = row[j] + 1, begin[j]
            row.append(best)
            begin.append(start)
    stop = min(range(m + 1), key=row.__getitem__)
    return row[stop], begin[stop], stop


def _costs(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> list[int]:
    """Least edits between the item and a part of the text that ends after each word (Myers' bit vectors).

    The part may start anywhere, or with ``anchored`` only at the first word.
    """
    n = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item.tolist()):
        where[word] |= 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, cost, out = mask, 0, n, []
    for word in text.tolist():
        same = where.get(word, 0)
        across = (((same & up) + up) ^ up) | same | down
        more, less = (down | ~(across | up)) & mask, up & across
        cost += bool(more & top) - bool(less & top)
        out.append(cost)
        more, less = (more << 1 | anchored) & mask, less << 1 & mask
        same |= down
        up, down = (less | ~(same | more)) & mask, more & same
    return out


def fit_long(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """As ``fit``, in time that grows with the text alone for most items; None beyond ``most`` edits."""
    costs = _costs(item, text)
    edits = min(costs, default=most + 1)
    if edits > most:
        return None
    stop = costs.index(edits) + 1
    back = _costs(item[::-1], text[max(0, stop - len(item) - most) : stop][::-1], anchored=True)
    size = min((k for k, c in enumerate(back, 1) if c == edits), key=lambda k: abs(k - len(item)))
    return edits, stop - size, stop


def _need(n: int) -> int:
    """Grams that an item of n words shares with every match."""
    return max(1, n - GRAM + 1 - GRAM * allowed(n))


def _pieces(n: int) -> list[tuple[int, int]]:
    """Start and stop of the pieces that an item of n words is embedded in."""
    count = -(-n // WALKED)
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


class Items:
    """Items of one block, ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str]):
        found = W.split(pa.array(texts, pa.large_string()), lower=True)
        hashes = W.word_hashes(found)
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        #: The pieces: words, item, and place in the item; short items are one piece.
        self._pieces: list[tuple[np.ndarray, int, int]] = []
        by_size: dict[int, list[int]] = defaultdict(list)
        self._tiny: dict[int, dict[int, list[int]]] = {n: defaultdict(list) for n in range(1, GRAM)}
        for i, (a, b) in enumerate(zip(found.first.tolist(), found.first[1:].tolist(), strict=False)):
            if b == a:
                continue
            item = len(self.ids)
            self.ids.append(ids[i])
            self.words.append(hashes[a:b])
            if b - a < GRAM:
                self._tiny[b - a][int(W.window_hashes(hashes[a:b], b - a, W.ROLL_A)[0])].append(item)
                continue
            for p, q in _pieces(b - a):
                by_size[q - p].append(len(self._pieces))
                self._pieces.append((hashes[a + p : a + q], item, p))
        self.sizes = sorted(by_size)
        grams, owner = [], []
        self._by_key: dict[int, list[int]] = defaultdict(list)
        self._known: dict[int, np.ndarray] = {}
        for k, n in enumerate(self.sizes):
            own = np.stack([self._pieces[i][0] for i in by_size[n]])
            own_keys = keys(own)
            self._known[n] = np.unique(own_keys)
            for i, row in zip(by_size[n], own_keys, strict=True):
                for key in set(row.tolist()):
                    self._by_key[key].append(i)
            every = np.unique(np.concatenate([W.window_hashes(w, GRAM, W.ROLL_A) for w in own]))
            grams.append(every)
            owner.append(np.full(len(every), k))
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        size = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self._gram, self._size = gram[order], size[order]

    def _starts(self, hits: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
        """Starts of windows of n words that hold as many of the grams at ``hits`` as a match must."""
        need, reach = _need(n), n + allowed(n)
        first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
        near = last - first <= reach - GRAM
        if not near.any():
            return np.zeros(0, np.int64)
        spread = reach - GRAM - (last - first)[near]
        starts = first[near][:, None] - np.arange(reach)[None, :]
        starts = np.unique(starts[np.arange(reach)[None, :] <= spread[:, None]])
        return starts[(starts >= low) & (starts < high)]

    def search(self, found: W.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, item id, start and stop in words, and edits, of the best match of each item in a text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, items in self._tiny.items():
            self._find(found, hashes, n, items, best)
        # Of long items, the stretches of text around their pieces.
        around: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for n, (starts, texts) in self._windows(found, hashes).items():
            for c in range(0, len(starts), 4096):
                self._look(found, hashes, starts[c : c + 4096], texts[c : c + 4096], n, best, around)
        for (t, item), stretches in around.items():
            self._compare(hashes, sorted(stretches), t, item, int(found.first[t]), best)
        for (t, item), (edits, start, stop) in best.items():
            yield t, self.ids[item], start, stop, edits

    def _find(self, found: W.Words, hashes: np.ndarray, n: int, items: dict[int, list[int]], best: dict) -> None:
        """Items of n words, too few for a gram, where they stand first in a text."""
        if not items or len(hashes) < n:
            return
        known = np.sort(np.array(list(items), np.uint64))
        rolled = W.window_hashes(hashes, n, W.ROLL_A)
        which = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
        hit = np.flatnonzero(known[which] == rolled)
        text = np.searchsorted(found.first, hit, "right") - 1
        hit, text = hit[hit + n <= found.first[text + 1]], text[hit + n <= found.first[text + 1]]
        _, first = np.unique(text * len(known) + which[hit], return_index=True)
        for s, t in zip(hit[first].tolist(), text[first].tolist(), strict=True):
            for item in items[int(rolled[s])]:
                best.setdefault((t, item), (0, s - int(found.first[t]), s - int(found.first[t]) + n))

    def _windows(self, found: W.Words, hashes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each size of pieces, starts and texts of the windows that hold enough of their grams."""
        if not len(self._gram) or len(hashes) < GRAM:
            return {}
        rolled = W.window_hashes(hashes, GRAM, W.ROLL_A)
        at = np.searchsorted(self._gram, rolled)
        hit = np.flatnonzero(self._gram[np.minimum(at, len(self._gram) - 1)] == rolled)
        if not len(hit):
            return {}
        # A gram may belong to pieces of several sizes: one entry for each.
        low, high = at[hit], np.searchsorted(self._gram, rolled[hit], "right")
        place = np.repeat(hit, high - low)
        entry = np.arange(len(place)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
        size = self._size[entry]
        text = np.searchsorted(found.first, place, "right") - 1
        order = np.lexsort((place, text, size))
        group = size[order] * (len(found.first) + 1) + text[order]
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for run in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            n, t = self.sizes[size[run[0]]], int(text[run[0]])
            if len(run) >= _need(n):
                a, b = int(found.first[t]), int(found.first[t + 1])
                starts = np.unique(np.maximum(self._starts(np.unique(place[run]), n, a - allowed(n), b), a))
                windows[n].append((starts, np.full(len(starts), t)))
        return {n: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for n, parts in windows.items()}

    def _compare(self, hashes: np.ndarray, stretches: list[tuple[int, int]], t: int, item: int, a: int, best: dict) -> None:
        """Compare a long item with these stretches of text t, which begins at word a; overlapping ones are one."""
        begins, ends = (np.array(x) for x in zip(*stretches, strict=True))
        cuts = np.flatnonzero(begins[1:] > np.maximum.accumulate(ends)[:-1]) + 1
        ends = np.maximum.reduceat(ends, [0, *cuts])
        for p, q in zip(begins[[0, *cuts]].tolist(), ends.tolist(), strict=True):
            done = fit_long(self.words[item], hashes[p:q], allowed(len(self.words[item])))
            if done and ((t, item) not in best or done[0] < best[(t, item)][0]):
                best[(t, item)] = (done[0], done[1] + p - a, done[2] + p - a)

    def _look(
        self, found: W.Words, hashes: np.ndarray, starts: np.ndarray, texts: np.ndarray, n: int, best: dict, around: dict
    ) -> None:
        """Check the windows of n words at these starts whose keys are those of pieces."""
        stops = found.first[texts + 1]
        inside = starts[:, None] + np.arange(n)
        windows = np.where(inside < stops[:, None], hashes[np.minimum(inside, len(hashes) - 1)], np.uint64(0))
        own_keys = keys(windows)
        known = self._known[n]
        met = np.flatnonzero(known[np.minimum(np.searchsorted(known, own_keys), len(known) - 1)] == own_keys)
        seen = set()
        for row, column in zip(*np.divmod(met, own_keys.shape[1]), strict=True):
            s, t, b = int(starts[row]), int(texts[row]), int(stops[row])
            a = int(found.first[t])
            for piece in self._by_key[int(own_keys[row, column])]:
                own, item, offset = self._pieces[piece]
                size = len(self.words[item])
                if size > n:
                    low, most = s - offset, allowed(size)
                    around[t, item].add((max(a, low - most), min(b, low + size + most)))
                    continue
                old = best.get((t, item))
                if (row, item) in seen or (old and (old[0] == 0 or old[1] <= s - a < old[2])):
                    continue
                seen.add((row, item))
                if s + n <= b and np.array_equal(windows[row], own):
                    best[(t, item)] = (0, s - a, s - a + n)
                    continue
                low = max(a, s - allowed(n))
                edits, start, stop = fit(own, hashes[low : min(b, s + n + allowed(n))])
                if edits <= allowed(n) and (old is None or edits < old[0]):
                    best[(t, item)] = (edits, start + low - a, stop + low - a)


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, in blocks of bounded size, of which the driver holds one at a time."""
    items = benchmark.select("item_id", "text").dropna()
    size = items.agg(F.sum(F.octet_length("text") + 8)).head()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        if part.num_rows:
            yield Items(part.column("item_id").to_pylist(), part.column("text").to_pylist())


_MATCH = "doc_id BIGINT, item_id BIGINT, start BIGINT, stop BIGINT, edits INT"


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, stop (words, stop exclusive) and edits: the best match of each pair.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; null texts and items without
    words match nothing; A-Z is lowered; other columns do not count; repeated rows of either give
    one row a pair, and so do rows that share an id but not the text.
    """

    def pass_over(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in W.slices(batches):
                found = W.split(batch.column("text"), lower=True)
                rows = list(items.search(found, W.word_hashes(found)))
                if rows:
                    text, item, start, stop, edits = zip(*rows, strict=True)
                    columns = [batch.column("doc_id").take(pa.array(text, pa.int64()))]
                    columns += [pa.array(c, pa.int64()) for c in (item, start, stop)] + [pa.array(edits, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "stop", "edits"])

        return docs.select("doc_id", "text").mapInArrow(run, _MATCH)

    spark = docs.sparkSession
    every, path = spark.createDataFrame([], _MATCH), f"{shared_folder(spark)}/llm-matches-{uuid.uuid4().hex}"
    for items in _blocks(benchmark):  # each block's matches go to the shared folder before the next block
        pass_over(items).write.mode("append").parquet(path)
        every = spark.read.schema(_MATCH).parquet(path)
    best = every.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "stop")).alias("m"))
    return best.select("doc_id", "item_id", "m.start", "m.stop", "m.edits")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose text holds an item (null texts stay).

    Only the texts go to Python, and one flag each comes back.
    """

    def clean(items: Items):
        @F.arrow_udf("boolean")
        def flags(texts: pa.Array) -> pa.Array:
            out = np.ones(len(texts), bool)
            done = 0
            for batch in W.slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
                found = W.split(batch.column("text"), lower=True)
                out[[done + row[0] for row in items.search(found, W.word_hashes(found))]] = False
                done += batch.num_rows
            return pa.array(out)

        return flags(F.coalesce("text", F.lit("")))

    first = True
    for items in _blocks(benchmark):
        docs = (docs if first else written(docs)).filter(clean(items))
        first = False
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the place."""
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
