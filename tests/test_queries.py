"""Every registered query against its SQL on the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from areaweave.plans.oracle import ORACLES
from areaweave.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    cursor = duck.execute(ORACLES[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
