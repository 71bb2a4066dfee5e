import os

import pytest

from citespark import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark embeddings pages conversations part lineitem orders customer nation events".split()


def same(spark, con, name):
    """The query gives the rows of its SQL; a query without SQL gives rows at all."""
    ours = Q.queries()[name](spark, SF)
    cols = sorted(ours.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in ours.collect())))
    if name not in Q.oracle_sql():
        assert got
        return
    res = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})")
    assert got == sorted(map(repr, res.fetchall()))


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return found


@pytest.mark.parametrize("name", list(Q.queries()))
def test_same_rows_as_sql(spark, con, name):
    same(spark, con, name)


def test_entry_registers_all(spark):
    import __spark_entry__ as E

    assert set(Q.queries()) <= set(E.queries())
    assert os.path.exists(SF) and E.entry(spark).limit(1).count() == 1
