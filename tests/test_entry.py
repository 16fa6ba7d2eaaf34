"""The driver contract, and a few queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p5_found", "p5_good", "walk_edges", "site_support", "copy_numbers", "interval_left", "event_components", "stream_store", "site_passes", "recruit_evidence", "recruit_pairs", "walked_kmers", "allele_normalised", "site_widened", "node_order"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(str, result.fetchall()))
    assert sorted(columns) == sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
