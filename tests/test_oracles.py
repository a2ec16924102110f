"""Every registered query with SQL, against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from emberline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    result = duck.execute(catalogue.ORACLES[name])
    there = [d[0] for d in result.description]
    assert sorted(there) == names
    assert got == sorted(repr([plain(r[there.index(c)]) for c in names]) for r in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_registered():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
