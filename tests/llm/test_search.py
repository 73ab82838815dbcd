import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from areaweave.llm import search as S
from tests.llm.conftest import frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, k):
    """Every score of every document, by definition."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(1 for _, c in counted if c)
    length = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        scored = []
        for doc, c in counted:
            score = 0
            for t in set(terms(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + 50 * sum(c.values()) * total // length
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, -(2**63) if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_terms_are_those_of_the_pattern():
    texts = ["", None, "It's A-b_c\x7fd", "ÀÉ x٣ 日本 1a", "İI\x00z", prose(1, 300)]
    found = S.terms(pa.array(texts))
    for i, text in enumerate(texts):
        assert [found.text(j).decode() for j in range(found.first[i], found.first[i + 1])] == terms(text)


@pytest.mark.parametrize("seed", range(25))
def test_search_of_a_segment_equals_all_scores(seed):
    r = np.random.default_rng(seed)
    n, t = int(r.integers(1, 400)), 12
    parts = []
    for docs in (n, max(1, n // 3)):
        mask = r.random((t, docs)) < r.random((t, 1))
        term, doc = np.nonzero(mask)
        parts.append(S.Postings(term, doc, r.integers(1, 4, len(term)), r.integers(5, 9, docs)))
    weight = r.integers(0, 5000, t)
    segment = S.Segment(parts, weight, 2 * n, 14 * n)
    k = int(r.integers(1, 30))
    for _ in range(8):
        query = np.unique(r.integers(0, t, int(r.integers(1, 8))))
        scores = np.zeros(segment.docs, np.int64)
        for q in query:
            a, b = segment.first[q], segment.first[q + 1]
            scores[segment.doc[a:b]] += segment.impact[a:b]
        order = np.lexsort((np.arange(segment.docs), -scores))[:k]
        order = order[scores[order] > 0]
        docs, points, _ = segment.best(query, k)
        assert docs[:k].tolist() == order.tolist() and points[:k].tolist() == scores[order].tolist()
        floor = int(scores[order[-1]]) if len(order) == k else 0
        assert set(segment.best(query, k, floor)[0]) >= set(order[scores[order] > floor].tolist())


def test_positions_marked_by_direct_access_end_the_search_early():
    # Both lists hold the same documents in the same order: what is met in one is marked in the other.
    n = 20_000
    doc = np.tile(np.arange(n), 2)
    tf = np.tile(np.arange(n, 0, -1), 2)
    part = S.Postings(np.repeat([0, 1], n), doc, tf, np.full(n, 10))
    segment = S.Segment([part], np.array([1000, 1000]), n, 10 * n)
    docs, _, read = segment.best(np.array([0, 1]), 5)
    assert docs[:5].tolist() == [0, 1, 2, 3, 4] and read < 1000


def items_of(r):
    return [(1, prose(1, 30)), (1, prose(2, 30)), (2, None), (3, "zzz"), (4, prose(3, 40)), (4, prose(3, 40)), (None, "river1 É"), (5, " ".join(r.choices(prose(9, 50).split(), k=9)))]


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_brute_force(spark, awkward, monkeypatch, small):
    rows, df = awkward
    if small:  # several blocks of queries
        monkeypatch.setattr(S, "QUERY_BYTES", 300)
    more = [(100 + k // 2, prose(k % 30, 25)) for k in range(160)]
    docs = df.unionAll(frame(spark, more))
    items = items_of(random.Random(3))
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id BIGINT, text STRING, rank INT")
    got = sorted(map(tuple, S.ranked_search(docs, asked, 20).collect()), key=repr)
    assert got == brute([*rows, *more], items, 20)


def test_empty_tables(spark, empty):
    asked = spark.createDataFrame([(1, "a b")], "item_id BIGINT, text STRING")
    assert S.ranked_search(empty, asked).count() == 0
    assert S.ranked_search(frame(spark, [(1, "a")]), asked.limit(0)).count() == 0
