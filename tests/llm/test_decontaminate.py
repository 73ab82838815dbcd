import random

import numpy as np
import pytest

from areaweave.llm import decontaminate as D
from tests.llm.conftest import frame, prose, thue_morse

ITEMS = [(k, " ".join(prose(1000 + k, 12 + 3 * k).split()).capitalize()) for k in range(15)]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "e") for i, t in rows], "item_id BIGINT, text STRING, edits STRING")


def planted(share, seed):
    """Texts with an item each, edited by that share of the allowed edits."""
    r, rows = random.Random(seed), []
    for k in range(60):
        item, text = ITEMS[r.randrange(len(ITEMS))]
        words = text.split()
        for _ in range(int(share * D.allowed(len(words)))):
            at, how = r.randrange(len(words)), r.random()
            words[at : at + (how < 0.7)] = [] if how < 0.35 else [f"edit{r.randrange(999)}"]
        host = prose(2000 + k, 60).split()
        at = r.randrange(len(host))
        rows.append((k, " ".join(host[:at] + words + host[at:]), item))
    return rows


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_recall_and_no_false_matches(spark, share):
    rows = planted(share, 7)
    clean = [(500 + k, prose(5000 + k, 80)) for k in range(30)]
    found = D.find_matches(frame(spark, [r[:2] for r in rows] + clean), items(spark)).collect()
    hits, truth = {(r.doc_id, r.item_id) for r in found}, {(k, i) for k, _, i in rows}
    assert len(hits & truth) >= (1 if share == 0 else 0.95) * len(truth)
    assert not any(d >= 500 for d, _ in hits)
    if share == 0:
        assert all(r.edits == 0 for r in found if (r.doc_id, r.item_id) in truth)


def test_places_are_exact(spark):
    text = "a b c " + ITEMS[4][1].upper() + " d e"
    row = D.find_matches(frame(spark, [(1, text)]), items(spark)).head()
    assert (row.item_id, row.start, row.stop, row.edits) == (4, 3, 3 + len(ITEMS[4][1].split()), 0)


def test_fit_is_the_edit_distance_to_the_best_part():
    assert D.fit(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 4, 9])) == (1, 1, 5)
    assert D.fit(np.array([1, 2]), np.array([], int))[0] == 2


def test_awkward_rows_and_blocks(spark, awkward, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)  # several passes
    rows, df = awkward
    odd = ITEMS + [(90, None), (91, ""), (92, "two words"), (None, "no id at all here"), (93, " ".join(rows[4][1].split()[3:15]))]
    found = D.find_matches(df, items(spark, odd)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(5, 93), (6, 93), (7, 93), (None, 93)}
    kept = D.remove_contaminated(df, items(spark, odd))
    assert kept.columns == df.columns and kept.count() == len(rows) - 4


def test_empty_tables(spark, empty, awkward):
    assert D.find_matches(empty, items(spark)).collect() == []
    assert D.find_matches(awkward[1], items(spark, [])).collect() == []
    assert D.remove_contaminated(awkward[1], items(spark, [])).count() == len(awkward[0])


def distinct(seed, n):
    r = random.Random(seed)
    return [f"w{x}" for x in r.sample(range(10**6), n)]


def hosts(item, count, how):
    """Texts with the item each, with all the edits it may have."""
    texts = []
    for k in range(count):
        r, words = random.Random(1000 * len(item) + k), list(item)
        for at in sorted(r.sample(range(len(item)), D.allowed(len(item))), reverse=True):
            kind = r.choice(["delete", "insert", "replace"]) if how == "mixed" else how
            words[at : at + (kind != "insert")] = [] if kind == "delete" else [f"edit{r.randrange(10**6)}"]
        texts.append(distinct(k, 50) + words + distinct(90 + k, 50))
    return texts


@pytest.mark.parametrize("how", ["delete", "insert", "replace", "mixed"])
@pytest.mark.parametrize("n", [12, 24, 36, 37, 60, 120, 240, 400])
def test_recall_does_not_fall_with_length(n, how):
    count = 60
    own = [distinct(7000 + k, n) for k in range(3)]
    block = D.Items([10, 11, 12], [" ".join(w) for w in own])
    found = D.W.split(D.pa.array([" ".join(t) for t in hosts(own[1], count, how)], D.pa.large_string()), lower=True)
    rows = list(block.search(found, D.W.word_hashes(found)))
    assert {i for _, i, *_ in rows} <= {11} and all(e <= D.allowed(n) for *_, e in rows)
    assert len({t for t, *_ in rows}) >= (0.95 if n <= D.WALKED else 1) * count


def test_items_below_three_words_are_found_as_they_stand():
    block = D.Items([1, 2, 3, 4], ["solo", "Two words", "", "words"])
    texts = ["one two words and two words", "a solo", "two", "words two x", "two\nWORDS"]
    found = D.W.split(D.pa.array(texts, D.pa.large_string()), lower=True)
    got = sorted(block.search(found, D.W.word_hashes(found)))
    assert got == [(0, 2, 1, 3, 0), (0, 4, 2, 3, 0), (1, 1, 1, 2, 0), (3, 4, 0, 1, 0), (4, 2, 0, 2, 0), (4, 4, 1, 2, 0)]


def test_words_that_weak_hashes_confuse():
    a, b = thue_morse(1024)
    block = D.Items([1], [f"x {a} y z"])
    found = D.W.split(D.pa.array([f"x {b} y z", f"x {a} y z"], D.pa.large_string()), lower=True)
    assert [row[0] for row in block.search(found, D.W.word_hashes(found))] == [1]


def test_fit_long_agrees_with_fit():
    r = np.random.default_rng(3)
    for _ in range(300):
        item, text = r.integers(0, 6, r.integers(1, 90)), r.integers(0, 6, r.integers(0, 120))
        edits, _, stop = D.fit(item, text)
        got = D.fit_long(item, text, len(item) - 1)
        if edits >= len(item):
            assert got is None
            continue
        assert (got[0], got[2]) == (edits, stop) and D.fit(item, text[got[1] : stop])[0] == edits
        assert D.fit_long(item, text, edits)[0] == edits
        assert edits == 0 or D.fit_long(item, text, edits - 1) is None


def test_long_items_in_repeated_text():
    own = distinct(1, 60)
    block = D.Items([5, 6], [" ".join(own), " ".join(own[:30] + distinct(2, 30))])
    text = own[:30] * 40 + own + own[:30] * 40
    found = D.W.split(D.pa.array([" ".join(text)], D.pa.large_string()))
    assert list(block.search(found, D.W.word_hashes(found))) == [(0, 5, 1200, 1260, 0)]
