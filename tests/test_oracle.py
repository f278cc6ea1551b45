"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 4)
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


#: Queries registered under several names are run under the first.
NAMES = {f: name for name, f in reversed(catalogue.queries().items()) if name in catalogue.oracle_sql()}


@pytest.mark.parametrize("name", sorted(NAMES.values()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert bag(got.columns, [tuple(r) for r in got.collect()]) == bag(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= names and set(__spark_entry__.oracle_sql()) <= names
    assert all(catalogue.oracle_sql().keys() <= catalogue.queries().keys() for _ in (0,))
