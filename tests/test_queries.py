from __future__ import annotations

import os

import duckdb
import pytest

from hexaloom.plans import queries as maps

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in maps.TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    value = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(maps.SQL))
def test_query_equals_sql(spark, duck, name):
    df = maps.QUERIES[name](spark, DATA)
    found = duck.execute(maps.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns, order) == plain(found.fetchall(), columns, order)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["som_train_flagship", "som_train_missing"])
def test_training_query_runs(spark, name):
    assert maps.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_full_fit_reads_whole_vectors(spark):
    df = maps.QUERIES["som_train_flagship"](spark, DATA)
    assert {f"B_f{i}" for i in range(64)} <= set(df.columns)
