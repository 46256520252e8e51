"""Every query with an SQL counterpart gives the same rows on a second engine."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from paperloom.plans.oracle import oracle_sql
from paperloom.plans.queries import QUERIES

ORACLE = oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in data), key=repr)


def test_all_sql_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"lr_predict", "kernel_predict", "ensemble_predict", "hybrid_classify", "retrain", "model_roundtrip"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() >= 5
