import random
import re
import zlib

import numpy as np
import pytest

from areaweave.llm import periodic as P
from tests.llm.conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Runs by definition: every stretch of equality at every lag."""
    out = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j + q), (i, j - i + q, q))
            i = j + 1
    return sorted(out.values(), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, l, q in runs for i in range(s + q, s + l)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def strings(seed):
    """Words over few letters, with repeated passages inside."""
    r = random.Random(seed)
    out = []
    while len(out) < r.randint(0, 120):
        part = [r.choice("abcde") for _ in range(r.randint(1, 9))]
        out += part * r.choice([1, 1, 2, 4, 5, 9])
    return out


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    words = strings(seed)
    ids = np.array([ord(w) for w in words], np.int64)
    got = []
    for a, b in P.surviving(ids, np.array([0, len(ids)])) if words else []:
        got += [(a + s, l, q) for s, l, q in P.runs_of(ids[a:b])]
    assert got == brute(words)


def test_a_nested_run_and_the_runs_inside_it():
    words = (["a"] * 6 + ["b"]) * 4
    ids = np.array([ord(w) for w in words])
    assert P.runs_of(ids) == brute(words) and (0, 28, 7) in P.runs_of(ids) and (0, 6, 1) in P.runs_of(ids)


def test_segments_of_many_texts_do_not_touch():
    ids = np.zeros(10, np.int64)
    assert P.surviving(ids, np.array([0, 4, 10])) == [(4, 10)]


def test_words_that_only_repeat_elsewhere_split():
    ids = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 3])
    assert P.surviving(ids, np.array([0, 14])) == []  # the parts hold too few of each


def test_query_equals_brute_force(spark, awkward, tmp_path):
    rows, _ = awkward
    rows = [*rows, *((100 + k, " ".join(strings(k))) for k in range(60)), (200, "x " * 9 + "\n" + "é ß " * 4), (-5, prose(8, 40))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, text in rows:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words) if len(words) < 2000 else []
        if len(words) >= 2000:
            assert h % 10
        best = min(((-l, s, q) for s, l, q in runs), default=None)
        longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
        import hashlib

        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{l},{q}\n" for s, l, q in runs), collapsed(words, runs))]
        want.append((i, len(words), len(runs), *longest, *digests))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, empty):
    assert P.periodic_runs(P.with_cycles(empty)).count() == 0


def test_a_long_periodic_text_has_few_lags():
    r = np.random.default_rng(1)
    ids = np.tile(r.integers(0, 10**6, 50_000), 4)
    assert P.lags(ids) == [50_000] and P.runs_of(ids) == [(0, 200_000, 50_000)]
