"""Registered queries against their SQL, on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from doeffect.llm.queries import ORACLE, QUERIES


def _norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_small, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        assert os.path.exists(f"{sf_small}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = QUERIES[name](spark, sf_small)
    found = db.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(found.fetchall(), names)
