from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return f"{v:.9g}" if isinstance(v, float) else str([value(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        assert [rel.columns[i] for i in order] == columns
        assert got == sorted(tuple(value(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
