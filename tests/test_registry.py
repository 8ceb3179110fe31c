"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import math
import os

import pytest

from tidemark.plans import cases, cases_whole, more, pipelines, registry  # noqa: F401

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return str(round(v, 4) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{sf_dir}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE:
        rel = db.sql(registry.ORACLE[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert rows == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
