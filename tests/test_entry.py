"""Driver contract: entry smoke run, registry/oracle agreement on sf0.001."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from doeffect.plans.oracle import ORACLE
from doeffect.plans.registry import QUERIES

def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in ("nation", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_entry_runs(spark, sf_small):
    df = entry.entry(spark)
    assert set(df.columns) >= {"dataset", "comparison", "prediction", "a", "total"}
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_small, duck, name):
    df = entry.queries()[name](spark, sf_small)
    mine = _rows([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert mine == _rows(res.fetchall(), cols)
