"""Queries on editions in which ids repeat, as they do where the number added to an id meets another key."""

from __future__ import annotations

import pytest

from lakewright.plans import catalogue
from tests.test_catalogue import ordered

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("repeated"))
    duckdb.sql(
        f"""COPY (SELECT (i % 400 + 1000000 * (i // 400))::BIGINT AS o_orderkey, (i % 31)::BIGINT AS o_custkey, substr('OFP', 1 + i % 3, 1) AS o_orderstatus, (i % 40) * 12.25::DOUBLE AS o_totalprice,
  TIMESTAMP '2024-01-01' AS o_orderdate, CASE i % 4 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM range(1200) t(i)) TO '{d}/orders.parquet' (FORMAT parquet)"""
    )
    return d


@pytest.mark.parametrize("name", ["concurrent_conflict", "isolate_one", "link_chain", "reproduction_check", "source_coverage", "sync_plan", "three_way_merge", "minimal_reconstruct"])
def test_repeated_ids_equal_sql(spark, repeated, name):
    df = catalogue.queries()[name](spark, repeated)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{repeated}/orders.parquet'")
    twin = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.columns, df.collect()) == ordered(names, twin.fetchall())
