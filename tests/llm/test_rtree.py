import random
import re

import numpy as np
import pytest

from areaweave.llm import rtree as R
from tests.llm.conftest import frame, prose, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of rows with distinct ids, by comparing all pairs."""
    sets = [(i, grams(t)) for i, t in rows]
    part = {i: i for i, s in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                low, high = sorted((root(i), root(j)))
                part[high] = low
    return sorted((i, len(s), root(i)) for i, s in sets)


def changed(text, k, seed):
    words, r = text.split(" "), random.Random(seed)
    for _ in range(k):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def copies(seed):
    """Texts with copies at every distance around the limit."""
    rows = []
    for k in range(40):
        text = prose(seed * 100 + k, random.Random(k).choice([3, 8, 9, 10, 11, 30, 80, 200, 500])).replace("\n", " ").strip()
        rows.append(text)
        size = len(text.split(" "))
        rows += [changed(text, max(0, int(size * share)), s) for s, share in enumerate([0, 0.01, 0.02, 0.03, 0.04, 0.08])]
        rows += [text + " more", text.rsplit(" ", 1)[0], text.upper()]
    random.Random(seed).shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("page", [1024, 4])
def test_join_equals_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(R, "PAGE", page)
    rows = copies(page)
    got = sorted(map(tuple, R.jaccard_join(frame(spark, rows)).collect()))
    assert got == brute(rows)
    assert 0 < sum(c != i for i, _, c in got) < len(rows)


def test_a_chain_of_links_and_a_group_that_is_not_linked(spark, monkeypatch):
    monkeypatch.setattr(R, "PAGE", 8)
    base = prose(5, 120).replace("\n", " ").split(" ")
    chain = [" ".join(base[k : k + 100]) for k in range(0, 20, 3)]
    near = [changed(" ".join(base[:100]), 6, k) for k in range(60)]
    rows = list(enumerate(chain + near))
    got = sorted(map(tuple, R.jaccard_join(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_linked_sets_share_a_page_and_pass_the_bound():
    r = np.random.default_rng(4)
    for n in [9, 10, 11, 12, 19, 20, 50, 199, 1000, 30_000]:
        for _ in range(20):
            a = np.unique(r.integers(0, 2**64, n, np.uint64))
            drop = int(r.integers(0, n // 10 + 1))
            add = int(r.integers(0, 3))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**64, add, np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 90 * (len(a) + len(b) - shared) or shared == len(a) == len(b):
                continue
            assert len(np.intersect1d(R.page_keys(a), R.page_keys(b)))
            bound = np.minimum(R.point(a), R.point(b)).astype(int).sum()
            assert bound >= shared and R.enough(bound, len(a), len(b))


def test_near_pairs_are_those_of_all_pairs():
    r = np.random.default_rng(3)
    points = np.concatenate([r.poisson(4, (1, 64)) + r.integers(0, 2, (50, 64)) for _ in range(6)])
    n = points.sum(1)
    got = sorted(tuple(sorted((i, j))) for i, others in R.near_pairs(points, n) for j in others.tolist())
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if R.enough(np.minimum(points[i], points[j]).sum(), n[i], n[j])]
    assert got == want


def test_awkward_rows(spark, awkward):
    rows, df = awkward
    got = sorted(map(tuple, R.jaccard_join(df).collect()), key=repr)
    whole = {5: 5, 6: 5, 7: 5, 8: 8, 10: 10, 11: 11, 4: 4}
    want = []
    for i, text in rows:
        component = whole.get(i, i) if i != 9 else 9
        want.append((i, len(grams(text)), component))
    assert got == sorted(want, key=repr)


def test_words_that_weak_hashes_confuse(spark):
    rows = [(1, thue_morse(1024)[0]), (2, thue_morse(1024)[1])]
    assert sorted(map(tuple, R.jaccard_join(frame(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 2)]


def test_empty_table(spark, empty):
    assert R.jaccard_join(empty).count() == 0
