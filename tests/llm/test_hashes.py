"""Words that a polynomial hash modulo a power of two takes for one, in every operator that compares hashes."""

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from areaweave.llm import bpe, neardup, quality, substrings, tokenfiles
from areaweave.llm import words as W
from tests.llm.conftest import frame, prose, thue_morse

PAIRS = [thue_morse(1024), thue_morse(2048)]


@pytest.mark.parametrize("pair", PAIRS)
def test_ids_are_the_librarys(pair):
    texts = [f"x {w} y" for w in pair] * 2
    for path, ids in (
        (public_tokenizers.path("word_bpe_49k.json"), bpe._model(public_tokenizers.path("word_bpe_49k.json"))[1].ids),
        (public_tokenizers.path("byte_bpe_50k.json"), tokenfiles.library_encoder(public_tokenizers.path("byte_bpe_50k.json"))),
    ):
        library = Tokenizer.from_file(path)
        got, first = ids(pa.array(texts))
        for i, text in enumerate(texts):
            assert got[first[i] : first[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_units_with_equal_hashes_keep_their_own_ids(monkeypatch):
    # Even if every word had the same hash, the bytes decide.
    monkeypatch.setattr(W, "word_hashes", lambda words: np.zeros(len(words.start), np.uint64))
    encoder = tokenfiles.Encoder(lambda units: (np.array([len(u) for u in units], np.uint32), np.ones(len(units), np.int64)))
    ids, first = encoder.ids(pa.array(["a bbb cc", "bbb  a", ""]))
    assert ids.tolist() == [1, 4, 3, 3, 1, 2] and first.tolist() == [0, 3, 6, 6]


@pytest.mark.parametrize("pair", PAIRS)
def test_sets_and_windows_differ(spark, pair):
    tail = " " + prose(3, 30).replace("\n", " ")
    docs = frame(spark, [(i, w + tail) for i, w in enumerate(pair)] + [(10 + i, w) for i, w in enumerate(pair)])
    a, b = neardup.shingle_sets(pa.array(pair))
    assert a[0] != b[0]
    groups = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert groups[10] == 10 and groups[11] == 11
    left = {r["doc_id"]: r["kept_text"].split(" ")[0] for r in substrings.remove_substrings(docs).collect()}
    assert left[0] == pair[0] and left[1] == pair[1]  # the first window of either is its own


def test_quality_score_equals_one_row_at_a_time(spark):
    r = np.random.default_rng(2)
    model = quality.Model(r.normal(0, 0.2, quality.SIZE), np.array([-0.4, 0.7]), np.array([0, 1, 2]))
    texts = [prose(k, n) for k, n in enumerate([1, 5, 40, 300])] + ["", None, PAIRS[0][0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    for row in quality.score(docs, model).collect():
        _, feature, value, _ = quality.word_features(W.split(pa.array([row["text"] or ""])))
        total = sum(model.weights[f] * v for f, v in zip(feature.tolist(), value.tolist(), strict=True))
        above = [1 / (1 + math.exp(-(total - cut))) for cut in model.thresholds]
        assert row["tail"] == pytest.approx(above[0]) and row["expected_grade"] == pytest.approx(sum(above))
