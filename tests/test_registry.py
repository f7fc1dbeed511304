"""A few registered queries against their SQL; the whole list is checked at a larger scale elsewhere."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
NAMES = ["clean_body", "page_seq", "upsert_latest", "tokenize_terms", "bm25_merge", "tokenize_stemmed", "hybrid_fallback", "xml_quarantine", "hybrid_two_roots"]

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    from registry.queries import QUERIES

    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    found = contract.queries()[name](spark, DATA)
    expected = connection.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert canonical(found.columns, found.collect()) == canonical(columns, expected.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
