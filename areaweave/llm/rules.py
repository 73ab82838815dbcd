"""Quality rules: counts that fail a text outright, then a labelling of its lines.

Method: a linear-chain conditional random field over a text's lines, with two labels, content
and boilerplate.  Features of a line (marks, capitals, repetition, length, ending) give each
label a weight, pairs of neighbouring labels have weights of their own, and Viterbi decoding
finds the best sequence.  The share of words in content lines decides.

The field is learned from a bounded sample of labelled documents: lines of low-quality ones
count as boilerplate, lines of good ones as content, but for short lines that several of them
share, which are boilerplate too.  All lines of these documents count, however many: texts
are cut into chunks whose sums are chained, so that long ones take few steps, and a
sample with many lines stays in Spark's tasks, which return sums only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import labelled, table, written

# The base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEATED_PERCENT, WINDOW = 50, 50, 3

#: Labelled documents of either quality from which the field is learned.
SAMPLE = 600
#: A line of at most SHARED_WORDS words in at least SHARED_BY documents of the sample is boilerplate.
SHARED_WORDS, SHARED_BY = 12, 5
#: Lines of a sample that the driver holds; beyond, each round of the training is a Spark job.
HELD = 200_000
#: Lines of a chunk, within which the sums of all chunks go on together.
CHUNK = 32
#: Share of words in content lines from which a text is kept.
KEEP = 0.5
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
_FEATURES = 10


class Field(NamedTuple):
    """Weights of boilerplate (label 1) against content for each feature, and of label pairs."""

    state: np.ndarray
    pair: np.ndarray


def _mask(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _mask(SYMBOLS)
_LOUD = _mask(SYMBOLS + b"!@=_~^+{}[]\\")
_UPPER, _DIGIT, _STOP = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b".!?:;\"'")


class Lines(NamedTuple):
    """Lines of a batch of texts that hold a word, and counts of the texts."""

    first: np.ndarray  # for each text, its first line (one entry more than texts)
    words: np.ndarray  # words in each line
    features: np.ndarray  # a row for each line
    base: dict[str, np.ndarray]  # word_chars, n_symbols, n_words, n_repeat_words of each text
    spans: np.ndarray  # start and end of each line in the data
    data: np.ndarray


def _total(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of flags set from a to b, for each pair."""
    up = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return up[b] - up[a]


def read_lines(texts: pa.Array) -> Lines:
    data, offset = W.flat(texts)
    found = W.split_bytes(data, offset)
    hashes = W.word_hashes(found)
    count = np.diff(found.first)
    text = np.repeat(np.arange(len(count)), count)

    # Words in windows that occur twice or more in their text.
    start = W.window_starts(found, WINDOW)
    window = W.window_hashes(hashes, WINDOW, W.ROLL_A)[start]
    order = np.lexsort((window, text[start]))
    owner, key = text[start][order], window[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (owner[1:] == owner[:-1]) & (key[1:] == key[:-1])
    again = start[order[same[:-1] | same[1:]]]
    covered = np.zeros(len(text) + WINDOW, bool)
    for k in range(WINDOW):
        covered[again + k] = True
    covered = covered[: len(text)]
    repeated_before = np.zeros(len(text), bool)
    by_word = np.lexsort((hashes, text))
    repeated_before[by_word[1:]] = (hashes[by_word[1:]] == hashes[by_word[:-1]]) & (text[by_word[1:]] == text[by_word[:-1]])

    letters = (data & 0xC0) != 0x80
    chars_in_words = _total(letters, found.start, found.end)
    base = {
        "n_words": count,
        "word_chars": np.bincount(text, chars_in_words, len(count)).astype(np.int64),
        "n_symbols": _total(_SYMBOL[data], offset[:-1], offset[1:]),
        "n_repeat_words": np.bincount(text, covered, len(count)).astype(np.int64),
    }

    # Lines: from one line feed, or text, to the next.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offset[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    line = np.searchsorted(begin, found.start, "right") - 1
    words = np.bincount(line, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    filled = np.flatnonzero(words)
    words, a, b = words[filled], begin[filled], end[filled]
    size = np.maximum(b - a, 1)
    first_word = np.concatenate([[0], np.cumsum(words)])
    last = data[found.end[first_word[1:] - 1] - 1] if len(filled) else np.zeros(0, np.uint8)
    first = np.searchsorted(a, offset)
    features = np.column_stack(
        [
            np.ones(len(filled)),
            np.minimum(10 * _total(_LOUD[data], a, b) / size, 3),
            np.minimum(3 * _total(_UPPER[data], a, b) / size, 3),
            np.minimum(5 * _total(_DIGIT[data], a, b) / size, 3),
            _total(covered, first_word[:-1], first_word[1:]) / np.maximum(words, 1),
            _total(repeated_before, first_word[:-1], first_word[1:]) / np.maximum(words, 1),
            np.log1p(words) / 4,
            _STOP[last].astype(float),
            (words < 6).astype(float),
            np.minimum(size / np.maximum(words, 1) / 10, 3),
        ]
    )
    return Lines(first, words, features, base, np.column_stack([a, b]), data)


def viterbi(scores: list[float], pair: list[list[float]]) -> list[int]:
    """Best labels of a text: ``scores`` are of label 1 against 0, ``pair`` of neighbouring labels."""
    a, b, back = 0.0, 0.0, []
    for i, s in enumerate(scores):
        if i:
            a0, a1 = a + pair[0][0], b + pair[1][0]
            b0, b1 = a + pair[0][1], b + pair[1][1]
            back.append((a1 > a0, b1 > b0))
            a, b = max(a0, a1), max(b0, b1)
        b += s
    if not scores:
        return []
    labels = [int(b > a)]
    for step in reversed(back):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def _log_add(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis))


class _Chunks:
    """Texts of these numbers of lines, one after the other, cut into chunks of CHUNK lines."""

    def __init__(self, lengths: np.ndarray):
        count = -(-lengths // CHUNK)
        text = np.repeat(np.arange(len(lengths)), count)
        first = np.cumsum(count) - count
        nth = np.arange(len(text)) - first[text]
        begin = (np.cumsum(lengths) - lengths)[text] + nth * CHUNK
        self.opens = nth == 0
        self.inside = np.arange(CHUNK) < (lengths[text] - nth * CHUNK)[:, None]
        self.lines = np.where(self.inside, begin[:, None] + np.arange(CHUNK), 0)
        # The k-th chunks of all texts that have so many, for each k after the first.
        order = np.argsort(nth, kind="stable")
        self.later = np.split(order, np.flatnonzero(np.diff(nth[order])) + 1)[1:]

    def forward(self, one: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """For each line and label, log of the sum over the ways to label its text up to there."""
        one = one[self.lines]
        # From each label before the chunk to each label of the line; a text begins without a pair.
        way = np.empty((*self.lines.shape, 2, 2))
        way[:, 0] = np.where(self.opens[:, None, None], 0, pair) + one[:, 0, None, :]
        for i in range(1, CHUNK):
            new = _log_add(way[:, i - 1, :, :, None] + pair, 2) + one[:, i, None, :]
            way[:, i] = np.where(self.inside[:, i, None, None], new, way[:, i - 1])
        before = np.tile([0.0, -1e30], (len(one), 1))
        for chunks in self.later:
            before[chunks] = _log_add(before[chunks - 1][:, :, None] + way[chunks - 1, -1], 1)
        return _log_add(before[:, None, :, None] + way, 2)[self.inside]


class Chains:
    """Labelled texts: features and labels of their lines, one text after the other."""

    def __init__(self, features: list[np.ndarray], labels: list[np.ndarray]):
        lengths = np.array([len(y) for y in labels])
        self._x, self._y = np.concatenate(features), np.concatenate(labels)
        self._last = np.cumsum(lengths) - 1
        self._text = np.repeat(np.arange(len(lengths)), lengths)
        self._pairs = np.flatnonzero(self._text[1:] == self._text[:-1])
        self._there, self._back = _Chunks(lengths), _Chunks(lengths[::-1])

    def sums(self, field: Field) -> np.ndarray:
        """Gradient of the log likelihood for state and pair weights, and the number of lines."""
        one = np.column_stack([np.zeros(len(self._x)), self._x @ field.state])
        forward = self._there.forward(one, field.pair)
        backward = self._back.forward(one[::-1], field.pair.T)[::-1]  # counts the line itself as well
        total = _log_add(forward[self._last], 1)[self._text]
        chance = np.exp(forward[:, 1] + backward[:, 1] - one[:, 1] - total)
        at = self._pairs
        joint = forward[at][:, :, None] + field.pair + backward[at + 1][:, None, :] - total[at][:, None, None]
        by_pair = -np.exp(np.minimum(joint, 0)).sum(0)
        y = self._y.astype(int)
        np.add.at(by_pair, (y[at], y[at + 1]), 1)
        return np.concatenate([(self._y - chance) @ self._x, by_pair.ravel(), [len(self._x)]])


def train(sums: Callable[[Field], np.ndarray], size: int = _FEATURES) -> Field:
    """Maximum likelihood by gradient ascent; ``sums`` as of Chains, over all texts."""
    weights, moments = np.zeros(size + 4), [np.zeros(size + 4) for _ in range(2)]
    field = Field(weights[:size], weights[size:].reshape(2, 2))
    for t in range(1, ROUNDS + 1):
        *gradient, lines = sums(field)
        step = np.array(gradient) / lines - RIDGE * weights
        moments = [0.9 * moments[0] + 0.1 * step, 0.99 * moments[1] + 0.01 * step**2]
        weights = weights + RATE * moments[0] / (1 - 0.9**t) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        field = Field(weights[:size], weights[size:].reshape(2, 2))
    return field


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: features of its lines, and their hashes if they are short (else 0)."""
    for batch in W.slices(batches):
        lines = read_lines(batch.column("text"))
        hashes = W.word_hashes(W.Words(lines.data, lines.spans[:, 0], lines.spans[:, 1], np.array([0])))
        keys = np.where(lines.words <= SHARED_WORDS, hashes, 0).astype(np.uint64).view(np.int64)
        rows = [
            (b - a, lines.features[a:b].tobytes(), keys[a:b].tobytes(), np.unique(keys[a:b]))
            for a, b in zip(lines.first.tolist(), lines.first[1:].tolist(), strict=False)
        ]
        n, features, own, short = zip(*rows, strict=True)
        columns = [batch.column("doc_id"), batch.column("grade"), pa.array(n, pa.int64()), pa.array(features, pa.binary())]
        columns += [pa.array(own, pa.binary()), pa.array(short, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "grade", "n", "features", "keys", "short"])


def _chains(rows: list[tuple[int, bytes, bytes]], often: np.ndarray) -> Chains:
    """Grade, features and keys of texts with lines; the keys in ``often`` are boilerplate anywhere."""
    keys = [np.frombuffer(k, np.int64) for _, _, k in rows]
    labels = [np.isin(k, often).astype(float) if g else np.ones(len(k)) for (g, _, _), k in zip(rows, keys, strict=True)]
    return Chains([np.frombuffer(f).reshape(-1, _FEATURES) for _, f, _ in rows], labels)


def _task_sums(field: Field, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "features", 8 * W.BLOCK):
            rows = zip(*(batch.column(c).to_pylist() for c in ("grade", "features", "keys")), strict=True)
            done = _chains(list(rows), often).sums(field)
            yield pa.RecordBatch.from_arrays([pa.array([done.tolist()], pa.list_(pa.float64()))], ["sums"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field, from all lines of at most ``sample`` documents of either quality; None without both."""
    known = labelled(docs, labels, F.col("quality"), sample).select("doc_id", "text", "grade")
    rows = known.mapInArrow(
        _sample_lines, "doc_id BIGINT, grade INT, n BIGINT, features BINARY, keys BINARY, short ARRAY<BIGINT>"
    )
    rows = written(rows).filter("n > 0")
    held = rows.groupBy(F.col("grade") > 0).agg(F.sum("n").alias("n")).collect()
    if len(held) < 2:
        return None
    shared = rows.select(F.explode("short").alias("key")).filter("key <> 0").groupBy("key").count()
    often = np.array([r["key"] for r in shared.filter(F.col("count") >= SHARED_BY).select("key").collect()], np.int64)
    if sum(r["n"] for r in held) <= HELD:
        data = rows.select("grade", "features", "keys").orderBy("doc_id").collect()
        return train(_chains([tuple(r) for r in data], often).sums)
    pieces = rows.select("grade", "features", "keys")
    return train(
        lambda field: np.sum([r["sums"] for r in pieces.mapInArrow(_task_sums(field, often), "sums ARRAY<DOUBLE>").collect()], 0)
    )


def _judged(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = field.pair.tolist() if field else []
        for batch in W.slices(batches):
            texts = batch.column("text")
            lines = read_lines(texts)
            score = (lines.features @ field.state).tolist() if field else []
            share, labels, equal = [], [], []
            raw = lines.data.tobytes()
            for a, b in zip(lines.first.tolist(), lines.first[1:].tolist(), strict=False):
                own = viterbi(score[a:b], pair) if field else [0] * (b - a)
                words = lines.words[a:b]
                content = int(words[np.array(own, bool) == 0].sum()) if b > a else 0
                share.append(content / max(1, int(words.sum())))
                labels.append(own)
                # A line without its line feed; the last one has none.
                strings = [raw[s:e].removesuffix(b"\n") for s, e in lines.spans[a:b].tolist()]
                equal.append(len(strings) - len(set(strings)))
            base = {k: pa.array(v.astype(np.int64)) for k, v in lines.base.items()}
            base |= {"n_dup_lines": pa.array(equal, pa.int64()), "content_share": pa.array(share, pa.float64())}
            base["boilerplate"] = pa.array(labels, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *base.values()], ["doc_id", *base])

    return run


def judge(docs: DataFrame, labels: DataFrame, least: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """Per document: the base counts, base_failed, content_share, line labels, and kept.

    ``text`` null has no words and so fails the base rules; other columns do not count;
    repeated rows are judged each.  ``boilerplate`` has 0 or 1 for each line with a word.
    Without labels of both qualities every line is content.
    """
    field = fit(docs, labels, sample)
    counts = ", ".join(f"{c} BIGINT" for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_dup_lines"))
    done = docs.select("doc_id", "text").mapInArrow(
        _judged(field), f"doc_id BIGINT, {counts}, content_share DOUBLE, boilerplate ARRAY<INT>"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return done.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= least))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    done = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )
