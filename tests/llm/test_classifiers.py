import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from areaweave.llm import quality as Q
from areaweave.llm import rules as R
from areaweave.llm import toxicity as T
from tests.llm.conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id BIGINT, quality INT, toxic INT, grade STRING"


def corpus(n=240):
    """Good, shouting and insulting texts by turns, and their labels."""
    rows, labels = [], []
    for i in range(n):
        text, kind = prose(i, 70), i % 3
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 2:
            words = text.split(" ")
            words[i % len(words)] = ("numpty", "blockhead", "grumbrax")[i % 9 // 3] + ("ing" if i % 9 // 3 == 2 else "")
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(kind != 1), int(kind == 2), "g"))
    return rows, labels


@pytest.fixture(scope="module")
def data():
    return corpus()


def test_quality_on_held_out_documents(spark, data):
    rows, labels = data
    known = spark.createDataFrame([x for x in labels if x[0] % 4], LABELS)
    done = Q.select_quality(frame(spark, rows).drop("kept"), known).collect()
    held = [r for r in done if r.doc_id % 4 == 0]
    assert np.mean([r.kept == (r.doc_id % 3 != 1) for r in held]) >= 0.97
    grade = {k: np.mean([r.expected_grade for r in done if r.doc_id % 3 == k]) for k in range(3)}
    assert grade[1] < grade[2] < grade[0]


def test_quality_thresholds_are_ordered(spark, data):
    rows, labels = data
    model = Q.fit(frame(spark, rows), spark.createDataFrame(labels, LABELS), Q.grades(), 60)
    assert (np.diff(model.thresholds) >= 0).all() and model.grades.tolist() == [0, 1, 2]


def test_quality_of_awkward_rows(spark, awkward, data):
    rows, df = awkward
    labels = spark.createDataFrame(data[1] + [(None, 1, 0, "g"), (1, None, None, "g"), (2, 0, 0, "g")], LABELS)
    done = Q.select_quality(df, labels).collect()
    assert len(done) == len(rows) and all(0 <= r.tail <= 1 for r in done)


def test_quality_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept and r.tail == 1 for r in Q.select_quality(awkward[1], none).collect())
    assert Q.select_quality(empty, none).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_automaton_matches_edit_distance():
    entries = ["numpty", "blockhead", "oaf", "grumbrax*"]
    automaton = T.Automaton(entries)
    words = ["numpty", "numptty", "nunpty", "umpty", "numpt", "numpties", "oaf", "oak", "blokhead", "blockheads",
             "grumbraxing", "grumbrx", "grumbraxx", "grmbraxed", "gr", "", "the", "numptx y"]
    for word in words:
        whole = [edits(word, e) for e in entries[:3] if edits(word, e) <= (len(e) >= T.EDIT_WORD)]
        stem = [d for n in range(len(word) + 1) if (d := edits(word[:n], "grumbrax")) <= 1]
        assert automaton.match(word) == (min(whole + stem) + 1 if whole + stem else 0), word


def test_toxicity_on_held_out_documents(spark, data, monkeypatch):
    rows, labels = data
    done = T.score_toxicity(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    from zlib import crc32

    held = [r for r in done if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == int(r.doc_id % 3 == 2) for r in held)


def test_labels_of_held_out_documents_do_not_count(spark, data):
    from zlib import crc32

    rows, labels = data
    held = lambda i: crc32(str(i).encode()) % 5 == 0
    turned = [(i, q, 1 - t if held(i) else t, g) for i, q, t, g in labels]
    a, b = (
        {r.doc_id: r.score for r in T.score_toxicity(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()}
        for x in (labels, turned)
    )
    assert a == b


def test_misspelled_and_quoted_hits(spark):
    rows = [(1, "you numptty here"), (2, 'they said "you numpty" to me'), (3, "NUMPTY!"), (4, None), (5, "")]
    hits = {r.doc_id: r for r in T.count_hits(frame(spark, rows), ["numpty"]).collect()}
    assert hits[1].misspelled == 1 and hits[3].exact == 1 and hits[2].exact_quoted == 1 and hits[2].exact == 0
    assert hits[4].exact == hits[5].exact == 0


def test_toxicity_of_awkward_rows_and_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], LABELS)
    assert all(r.score == 0 and r.predicted == 0 for r in T.score_toxicity(awkward[1], none).collect())
    assert T.score_toxicity(empty, none).collect() == []


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_rules_match_brute_force(spark, awkward, data):
    rows = awkward[0] + [(50, "a b c a b c d\n\na b c\n a b c\na b c"), (51, "x\nx\n\nx"), (52, "é# 日|\r\n|\r\n")] + data[0][:20]
    got = R.judge(frame(spark, rows), spark.createDataFrame([], LABELS)).collect()
    found = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == sorted((i or -1, *counts(t)) for i, t in rows)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)


def test_lines_are_labelled(spark, data):
    rows, labels = data
    mixed = [(900, prose(9001, 80) + "\n" + "BUY!! NOW!! HERE!!\n" * 3), (901, prose(9002, 80))]
    done = {r.doc_id: r for r in R.judge(frame(spark, rows + mixed), spark.createDataFrame(labels, LABELS)).collect()}
    good = [r for i, r in done.items() if i < 900 and i % 3 == 0]
    bad = [r for i, r in done.items() if i < 900 and i % 3 == 1]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.05
    assert done[900].boilerplate[-1] == 1 and done[900].boilerplate[0] == 0 and done[901].kept


def test_viterbi_finds_the_best_sequence():
    r = np.random.default_rng(4)
    for _ in range(200):
        scores, pair = r.normal(size=6).tolist(), r.normal(size=(2, 2)).tolist()
        best = max(
            (sum(s for s, y in zip(scores, ys, strict=True) if y) + sum(pair[a][b] for a, b in zip(ys, ys[1:], strict=False)), ys)
            for ys in ([k >> b & 1 for b in range(6)] for k in range(64))
        )
        assert R.viterbi(scores, pair) == best[1]
    assert R.viterbi([], [[0, 0], [0, 0]]) == []


def test_rules_on_an_empty_table(spark, empty):
    assert R.judge(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_gradient_of_chained_chunks_is_that_of_the_likelihood():
    r = np.random.default_rng(5)
    lengths = [1, 2, 31, 32, 33, 64, 150, 1]
    x = [r.normal(size=(n, 3)) for n in lengths]
    y = [r.integers(0, 2, n).astype(float) for n in lengths]

    def likelihood(w):
        pair, whole = w[3:].reshape(2, 2), 0.0
        for xs, ys in zip(x, y, strict=True):
            s = xs @ w[:3]
            ways = np.array([0.0, s[0]])
            for v in s[1:]:
                ways = np.array([np.logaddexp(*(ways + pair[:, q])) + q * v for q in (0, 1)])
            labels = ys.astype(int)
            whole += (s * ys).sum() + pair[labels[:-1], labels[1:]].sum() - np.logaddexp(*ways)
        return whole

    w = r.normal(size=7)
    *got, lines = R.Chains(x, y).sums(R.Field(w[:3], w[3:].reshape(2, 2)))
    steps = 1e-5 * np.eye(7)
    assert lines == sum(lengths)
    assert np.allclose(got, [(likelihood(w + d) - likelihood(w - d)) / 2e-5 for d in steps], atol=1e-4)


def test_lines_at_the_end_of_long_texts_are_learned(spark, monkeypatch):
    def lines(seed, n):
        return "\n".join(" ".join(prose(1000 * seed + k, 8).split()) for k in range(n))

    footer = "\n".join(f"follow us for more like this {k}" for k in range(30))
    cut = [(i, lines(i, 210) if i % 2 else lines(i, 210).upper()) for i in range(12)]
    full = [(i, f"{t}\n{footer}" if i % 2 else t) for i, t in cut]
    labels = spark.createDataFrame([(i, i % 2, 0, "g") for i in range(12)], LABELS)
    short, whole = R.fit(frame(spark, cut), labels), R.fit(frame(spark, full), labels)
    assert not np.allclose(short.state, whole.state, atol=1e-3)
    monkeypatch.setattr(R, "HELD", 0)  # the rounds as Spark jobs
    monkeypatch.setattr(R, "ROUNDS", 5)
    again = R.fit(frame(spark, full), labels)
    monkeypatch.setattr(R, "HELD", 10**6)
    held = R.fit(frame(spark, full), labels)
    assert np.allclose(again.state, held.state) and np.allclose(again.pair, held.pair)
