import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_sql_only_for_known_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert contract.entry(spark).columns == ["entry_id", "chunk_id", "rrf", "position"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["bm25_batch", "retrieval_metrics", "cache_lookup", "first_wins_dedup", "route_margin"])
def test_against_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    cur = con.execute(contract.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    rounded = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    want = rounded([tuple(r) for r in cur.fetchall()])
    assert rounded([tuple(r) for r in contract.queries()[name](spark, SF).select(*cols).collect()]) == want
