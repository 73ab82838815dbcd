import corpus_pipeline as P
import pytest

import __spark_entry__ as entry
from areaweave.llm import bpe
from tests.llm.conftest import prose
from tests.llm.test_classifiers import LABELS, corpus
from tests.llm.test_lines import brute as lines_of
from tests.llm.test_neardup import brute as groups_of

COLUMNS = ["doc_id", "text", "lang", "n_chars", "kept", "tail"]
ITEM = " ".join(prose(7777, 20).split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark as tables, with copies, passages and leaks among them."""
    path = tmp_path_factory.mktemp("tables")
    rows, labels = corpus(120)
    shared = "\n".join(prose(600 + k, 6).replace("\n", " ") for k in range(4))
    more = [(200, rows[0][1]), (201, rows[3][1] + " more"), (202, rows[6][1] + "\n" + shared), (203, rows[9][1] + "\n" + shared)]
    more += [(204, prose(61, 30) + " " + ITEM + " " + prose(62, 30)), (205, None), (206, ""), (None, prose(63, 40))]
    docs = spark.createDataFrame(
        [(i, t, "en", len(t or ""), True, "t") for i, t in rows + more],
        "doc_id BIGINT, text STRING, lang STRING, n_chars BIGINT, kept BOOLEAN, tail STRING",
    )
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id BIGINT, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = P.STAGES[0][1](spark, docs, folder)
    assert good.columns == COLUMNS
    before = [(r.doc_id, r.text) for r in good.collect()]
    assert {i for i, _ in before if i is not None and i < 120} == {i for i in range(120) if i % 3 != 1}

    short = P.STAGES[1][1](spark, good, folder)
    after = [(r.doc_id, r.text) for r in short.collect()]
    assert sorted(after, key=repr) == sorted(((i, t) for i, t, _, _ in lines_of(before)), key=repr)
    assert short.columns == COLUMNS and all(r.n_chars == len(r.text) for r in short.collect())

    single = P.STAGES[2][1](spark, short, folder)
    want = {i for i, _, c in groups_of(after) if i == c}
    assert {r.doc_id for r in single.collect()} == want and single.columns == COLUMNS

    clean = P.STAGES[3][1](spark, single, folder)
    assert {r.doc_id for r in clean.collect()} == want - {204} and clean.columns == COLUMNS

    last = P.STAGES[4][1](spark, clean, folder)
    assert sorted(map(tuple, P.run(spark, folder).collect()), key=repr) == sorted(map(tuple, last.collect()), key=repr)
    assert sorted(map(tuple, bpe.digests(clean).collect()), key=repr) == sorted(map(tuple, last.collect()), key=repr)


def test_stages_of_an_empty_table(spark, folder, empty):
    docs = empty.select("doc_id", "text", "kept", "tail")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_line_oracle_on_the_tables(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            cursor = con.execute(sql)
            columns = [c[0] for c in cursor.description]
            got = entry.queries()[name](spark, folder).select(*columns).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(cursor.fetchall(), key=repr)
