"""Every k-mer query against its SQL, on the smallest tables."""

import duckdb
import pytest

from strandlake.plans import kmer_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(kmer_queries.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = kmer_queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    mine = sorted(tuple(map(str, r)) for r in got.select(*cols).collect())
    theirs = sorted(tuple(map(str, r)) for r in duck.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({kmer_queries.ORACLE_SQL[name]})").fetchall())
    assert mine == theirs


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
