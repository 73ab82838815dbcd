"""Quality classifier: ordinal regression on graded ratings.

A cumulative-link model: one weighted sum of hashed features of the text, and ordered
thresholds that cut it into grades; P(grade > k) is the logistic function of sum - threshold k.
So all grades share their weights.  The features are the words (hashed), the shapes of the
words (classes of first and last letters, length), and repetition.  Scoring is one pass over
the texts; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import labelled, table

#: Labelled documents of each grade from which the weights are learned.
SAMPLE = 1500
#: Hashed words; then shapes; then three numbers of repetition and length.
WORDS, SHAPES, EXTRA = 1 << 14, 6 * 6 * 6 * 8, 3
SIZE = WORDS + SHAPES + EXTRA
#: Documents are kept if their probability of a grade above the lowest is at least this.
KEEP = 0.5
ROUNDS, RATE, RIDGE = 250, 0.05, 1e-3


def _byte_classes() -> np.ndarray:
    """Lower case 0, upper case 1, digits 2, sentence marks 3, other marks 4, beyond ASCII 5."""
    out = np.full(256, 4, np.int64)
    out[128:] = 5
    for first, last, kind in ((97, 122, 0), (65, 90, 1), (48, 57, 2)):
        out[first : last + 1] = kind
    out[[ord(c) for c in ".,;:?'\"()-"]] = 3
    return out


_CLASS = _byte_classes()


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray


def word_features(found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value of everything that adds to a text's sum; and words in each text."""
    count = np.diff(found.first)
    text = np.repeat(np.arange(len(count)), count)
    hashes = W.word_hashes(found)
    last = found.end - 1
    before = np.maximum(last - 1, found.start)
    first_class, before_class, last_class = (_CLASS[found.data[i]] for i in (found.start, before, last))
    length = np.minimum((found.end - found.start) // 3, 7)
    shape = ((first_class * 6 + before_class) * 6 + last_class) * 8 + length
    n = np.maximum(count, 1).astype(float)
    same = np.zeros(len(text), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    # Words that stand in the text before: lists and lines that turn in circles.
    order = np.lexsort((hashes, text))
    again = np.zeros(len(text), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    texts = np.arange(len(count))
    extra = [
        np.bincount(text, same, len(count)) / n,
        np.bincount(text, again, len(count)) / n,
        np.log1p(count) / 10,
    ]
    where = np.concatenate([text, text, *[texts] * EXTRA])
    feature = np.concatenate(
        [
            (hashes % np.uint64(WORDS)).astype(np.int64),
            WORDS + shape,
            *(np.full(len(texts), WORDS + SHAPES + k) for k in range(EXTRA)),
        ]
    )
    value = np.concatenate([1 / np.sqrt(n)[text], 3 / n[text], *extra])
    return where, feature, value, count


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to their features, summed, as packed arrays."""
    for batch in W.slices(batches, most=1 << 20):
        where, feature, value, _ = word_features(W.split(batch.column("text")))
        keys, which = np.unique(where * SIZE + feature, return_inverse=True)
        total = np.bincount(which, value, len(keys))
        cut = np.searchsorted(keys, np.arange(batch.num_rows + 1) * SIZE)
        feature = (keys % SIZE).astype(np.int32)
        packed = [
            (feature[a:b].tobytes(), total[a:b].astype(np.float32).tobytes()) for a, b in zip(cut, cut[1:], strict=False)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("grade"), *(pa.array(c, pa.binary()) for c in zip(*packed, strict=True))],
            ["doc_id", "grade", "features", "amounts"],
        )


def fit(docs: DataFrame, labels: DataFrame, grade, sample: int = SAMPLE) -> Model | None:
    """The model, from at most ``sample`` documents of each grade; None if there are not two grades."""
    known = labelled(docs, labels, grade, sample).select("doc_id", "text", "grade")
    rows = known.mapInArrow(_rows, "doc_id BIGINT, grade INT, features BINARY, amounts BINARY")
    # Bounded: the sample, and SIZE features of each document.
    data = rows.orderBy("doc_id").collect()
    grades = np.unique([r["grade"] for r in data])
    if len(grades) < 2:
        return None
    y = np.searchsorted(grades, [r["grade"] for r in data])
    feature = np.concatenate([np.frombuffer(r["features"], np.int32) for r in data])
    amount = np.concatenate([np.frombuffer(r["amounts"], np.float32) for r in data]).astype(float)
    row = np.repeat(np.arange(len(data)), [len(r["features"]) // 4 for r in data])
    weight = (1 / np.bincount(y))[y] / len(grades)  # each grade counts the same
    w, cuts = np.zeros(SIZE), np.linspace(-1, 1, len(grades) - 1)
    moments = [np.zeros(SIZE + len(cuts)) for _ in range(2)]
    for t in range(1, ROUNDS + 1):
        total = np.bincount(row, w[feature] * amount, len(data))
        p = 1 / (1 + np.exp(-np.clip(total[:, None] - cuts, -30, 30)))
        # Likelihood of a grade: P(> k-1) - P(> k).
        ends = np.column_stack([np.ones(len(y)), p, np.zeros(len(y))])
        slope = ends * (1 - ends)
        at = np.arange(len(y))
        share = np.maximum(ends[at, y] - ends[at, y + 1], 1e-9)
        by_total = (slope[at, y] - slope[at, y + 1]) / share * weight
        by_cut = np.zeros(len(cuts) + 2)
        np.add.at(by_cut, y, -slope[at, y] / share * weight)
        np.add.at(by_cut, y + 1, slope[at, y + 1] / share * weight)
        step = np.concatenate([np.bincount(feature, by_total[row] * amount, SIZE) - RIDGE * w, by_cut[1:-1]])
        moments = [0.9 * moments[0] + 0.1 * step, 0.99 * moments[1] + 0.01 * step**2]
        move = RATE * moments[0] / (1 - 0.9**t) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-6)
        w += move[:SIZE]
        cuts = np.sort(cuts + move[SIZE:])
    return Model(w, cuts, grades)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``expected_grade`` and ``tail``, the probability of a grade above the lowest, to ``docs``.

    ``text`` null counts as empty; columns of ``docs`` with these two names are replaced.
    """
    kept = [f for f in docs.schema if f.name not in ("expected_grade", "tail")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.diff(model.grades)
        for batch in W.slices(batches, most=1 << 20):
            where, feature, value, _ = word_features(W.split(batch.column("text")))
            total = np.bincount(where, model.weights[feature] * value, batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total[:, None] - model.thresholds, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.grades[0] + p @ steps), pa.array(p[:, 0].copy())],
                [*batch.schema.names, "expected_grade", "tail"],
            )

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, ", ".join([*names, "expected_grade DOUBLE", "tail DOUBLE"]))


def grades():
    """Grades of the labels at hand: 0 for low quality, 1 for good but toxic, 2 for good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def select_quality(docs: DataFrame, labels: DataFrame, grade=None, least: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail`` and ``kept`` (tail at least ``least``).

    Learns from at most ``sample`` labelled documents of each grade.  With fewer than two
    grades in ``labels`` nothing can be told, and every document is kept with a tail of 1.
    """
    model = fit(docs, labels, grades() if grade is None else grade, sample)
    if model is None:
        none = docs.withColumn("expected_grade", F.lit(None).cast("double"))
        return none.withColumn("tail", F.lit(1.0)).withColumn("kept", F.lit(True))
    return score(docs, model).withColumn("kept", F.col("tail") >= least)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade, probability and verdict of every document."""
    done = select_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "expected_grade", "tail", "kept")
