import random
import re

import numpy as np
import pytest

from areaweave.llm import neardup as N
from areaweave.llm.components import components
from tests.llm.conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    """n_shingles, component and kept of each row with a doc_id, by comparing all pairs of different texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    known = sorted({(i, frozenset(s)) for i, s in sets if i is not None and s}, key=lambda x: x[0])
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), find(i) if s and i is not None else i) for i, s in sets), key=repr)


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(1000)}"
    return " ".join(words)


def run(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize("block", [256, 4])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    base, other = prose(1, 120), prose(2, 12)
    rows = [(i, edited(base, i, i % 6)) for i in range(40)]  # near copies around the threshold
    rows += [(100 + i, edited(other, i, i % 2)) for i in range(12)]  # short texts
    rows += [(200 + i, prose(i + 50, 60)) for i in range(30)] + [(300 + i, base) for i in range(20)]
    chain = base
    for i in range(8):  # a chain: neighbours are linked, the ends are not
        chain = edited(chain, 900 + i, 2)
        rows.append((400 - i, chain))
    random.Random(1).shuffle(rows)
    assert run(frame(spark, rows).repartition(4)) == brute(rows)


def test_awkward_rows(spark, awkward):
    rows, df = awkward
    assert run(df) == [
        r if r[0] is not None else (None, r[1], None) for r in brute(rows)
    ]
    kept = {(r.doc_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert (5, True) in kept and (6, False) in kept and (None, True) in kept and (2, True) in kept


def test_empty_table(empty):
    assert N.near_duplicates(empty).collect() == []


def test_estimate_is_close():
    r = np.random.default_rng(1)
    errors = []
    for shared in (0, 200, 500, 800):
        for _ in range(10):
            both = r.integers(0, 2**63, shared, dtype=np.uint64) * 2
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**63, 1000 - shared, dtype=np.uint64) * 2 + 1])) for _ in range(2))
            x, y = N.signatures([a, b])
            estimate = N.similarity(np.array([(x == y).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
            errors.append(estimate - shared / (2000 - shared))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_equal_sets_have_equal_registers():
    value = np.uint64(0b0001011 << 49)
    same = N.signatures([np.array([value]), np.array([value])])
    assert (same[0] == same[1]).all() and same.min() > 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (202, 201), (201, 202)]
    found = dict(components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(20)} == {100} and found[202] == 201
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0
