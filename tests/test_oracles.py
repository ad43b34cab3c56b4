"""Every registered query with SQL gives the same rows in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from rillflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def compare(spark, query, sql, d, digits=None):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = query(spark, d)
    rel = con.sql(sql)
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    a = sorted((tuple(canonical(r[c]) for c in order) for r in got.collect()), key=str)
    at = [rel.columns.index(c) for c in order]
    b = sorted((tuple(canonical(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
