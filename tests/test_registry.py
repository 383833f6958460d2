"""Every registered catalogue query against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from arbordex import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and v != int(v) else int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted_rows(got.columns, [tuple(r) for r in got.collect()]) == sorted_rows(columns, want.fetchall())


def test_flagship(spark, sf_dir):
    assert 0 < registry.flagship(spark, sf_dir).count() <= 64
