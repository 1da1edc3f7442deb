"""Every registered query against its DuckDB form on the small tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.registry import CATALOGUE

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, e in CATALOGUE.items() if e.oracle))
def test_matches_oracle(spark, duck, name):
    got = CATALOGUE[name].run(spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(CATALOGUE[name].oracle)
    assert sorted(want.columns) == columns
    rows = Counter(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    expected = Counter(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
    assert sum(expected.values()) == sum(rows.values())
    assert rows == expected


WITHOUT = {"communities": "id", "vector_clusters": "id"}


def test_queries_without_oracle_are_known():
    assert {n for n, e in CATALOGUE.items() if not e.oracle} == set(WITHOUT)


@pytest.mark.parametrize("name", sorted(WITHOUT))
def test_without_oracle(spark, name):
    """Each row of the input has one result, and a second run gives the same; what it means is tested with the operators."""
    first, second = (sorted(map(tuple, CATALOGUE[name].run(spark, SF).collect())) for _ in range(2))
    assert first and first == second and len({r[0] for r in first}) == len(first)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
