"""The driver's contract: every query has SQL, and the engine's agree with it."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from quillon import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else value


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["sum", "s_suppkey"]


def test_names():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    ours = catalogue.queries()[name](spark, SF)
    theirs = db.sql(catalogue.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    expected = sorted(str(tuple(plain(r[k]) for k in order)) for r in theirs.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in ours.collect()) == expected
