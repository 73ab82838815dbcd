import re

from areaweave.llm import substrings as S
from tests.llm.conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """Rows in order; what is kept of each, as words."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        words = WORD.findall(rows[k][1] or "")
        gone = set()
        for i in range(len(words) - width + 1):
            first = seen.setdefault(tuple(words[i : i + width]), (rows[k], i))
            if first != (rows[k], i):
                gone.update(range(i, i + width))
        out.append((rows[k][0], " ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone)))
    return sorted(out, key=repr)


def run(df, **more):
    done = S.remove_substrings(df, **more)
    return sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in done.collect()), key=repr)


def test_matches_brute_force_with_hot_passages(spark, monkeypatch):
    hot, warm = prose(100, 45), prose(101, 30)
    rows = [(i, prose(i, 25) + (hot if i % 3 == 0 else "") + prose(i + 500, 15) + (warm if i % 7 == 0 else "")) for i in range(80)]
    rows += [(90, hot + hot + warm), (91, prose(1, 25) + hot)]
    want = brute(rows, 20)
    assert run(frame(spark, rows).repartition(5)) == want
    monkeypatch.setattr(S, "UNIT", 200)  # many units, so that first and later ones meet in the buckets
    assert run(frame(spark, rows).repartition(5), bucket_bytes=500) == want


def test_awkward_rows(spark, awkward):
    rows, df = awkward
    # The two texts of doc_id 9 share nothing, nor do those without one that repeat none.
    assert run(df) == brute(rows, 20)


def test_intervals_are_maximal(spark):
    a = prose(5, 30).replace("\n", " ")
    row = S.remove_substrings(frame(spark, [(1, a), (2, "x " + a + " y")])).filter("doc_id = 2").head()
    assert [(s.start, s.stop) for s in row.removed] == [(1, 31)] and row.kept_text == "x y"


def test_empty_table(empty):
    assert S.remove_substrings(empty).collect() == []
