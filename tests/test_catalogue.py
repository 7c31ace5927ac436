"""Every query against its SQL twin on the driver's tables."""

from __future__ import annotations

import math
import os

import pytest

from lakewright.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def ordered(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, sf_dir, tables, name):
    df = catalogue.queries()[name](spark, sf_dir)
    twin = tables.execute(catalogue.oracle_sql()[name])
    names, kinds = [c[0] for c in twin.description], [str(c[1]) for c in twin.description]
    assert sorted(df.columns) == sorted(names)
    assert {k: KINDS.get(t, t) for k, t in df.dtypes} | {} == {n: k.replace("DECIMAL", "decimal") if k.startswith("DECIMAL") else k for n, k in zip(names, kinds)}
    assert ordered(df.columns, df.collect()) == ordered(names, twin.fetchall())


def test_entry_and_guard():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
