import re

import duckdb

from areaweave.llm import lines as L
from tests.llm.conftest import frame

HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows, width=3):
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own, gone = (text or "").split("\n"), set()
        for k in range(len(own) - width + 1):
            key = tuple(own[k : k + width])
            if HAS_WORD.search("".join(key)) and seen.setdefault(key, (i, text, k)) != (i, text, k):
                gone.update(range(k, k + width))
        kept = "\n".join(line for k, line in enumerate(own) if k not in gone)
        out.append((i, kept, len(own), len(gone)))
    return sorted(out, key=repr)


def run(df):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in L.remove_lines(df).collect()), key=repr)


ROWS = [(i, "\n".join([f"own {i}", "a", "b", "c", "d" if i % 2 else "e", f"last {i}"])) for i in range(30)]
ROWS += [(40, "a\nb\nc\na\nb\nc\n"), (41, "\n\n\n\n"), (42, "x\n\n\n\n\ny"), (43, "x\n\n\n\n\ny")]


def test_matches_brute_force_and_sql(spark):
    want = brute(ROWS)
    assert run(frame(spark, ROWS).repartition(3)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    found = {(r[0], r[1], r[2]) for r in con.execute(L.ORACLE).fetchall()}
    assert found == {(i, n, g) for i, _, n, g in want}


def test_hot_runs_take_the_other_join(spark, monkeypatch):
    from areaweave.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 0.05)  # counts as large; keys with over 1/0.05 of all rows are hot
    assert run(frame(spark, ROWS)) == brute(ROWS)


def test_awkward_rows_and_carried_columns(spark, awkward):
    rows, df = awkward
    assert run(df) == brute(rows)
    carried = L.remove_lines(df, rest=("kept", "_id", "rest")).select("rest.*").distinct().collect()
    assert [tuple(r) for r in carried] == [(True, "z", "r")]


def test_empty_table(empty):
    assert L.remove_lines(empty).collect() == []


def test_no_python_in_the_plan(spark, awkward):
    plan = L.remove_lines(awkward[1])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
