"""The SQL of the operators on the rows that are hard to agree on."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import ODD, SCHEMA  # noqa: E402

from arbordex.llm.queries import QUERIES, SQL  # noqa: E402

NAMELESS = [(None, f"only here {n}\nshared by rows without an id", "en", "a", 1) for n in range(9)]
NAMELESS += [(400, "shared by rows without an id\nand one with", "en", "a", 1), (401, "मेरा नाम " * 20 + "привет, МИР! Ünï", "hi", None, 1)]
TURNS = [(-1, 0, "assistant", None), (-1, None, None, 'a "b" <turn>\\'), (-2, 1, "assistant", "x\r\n\\<é"), (-2, 0, "assistant", "</turn>\n"), (None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "assistant", "")]
VECTORS = [(0, [1.0, 2.0]), (50, [2.0, 0.0]), (50, [1.0, 5.0]), (None, [9.0, 9.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (100, [-1.0, -0.001]), (7, [0.3, 0.3])]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [*ODD, *NAMELESS]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"file://{at}/conversations.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").write.parquet(f"file://{at}/embeddings.parquet")
    labels = [(5, 1, 0), (7, 1, 0), (7, 0, 1), (None, 1, 1), (100, None, 1), (205, 1, None), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", list(SQL))
def test_sql_equals_the_query(spark, odd_dir, sf_dir, name):
    for at, pattern in ((odd_dir, "/*.parquet"), (sf_dir, "")):
        con = duckdb.connect()
        for table in ("documents", "conversations", "embeddings", "labels"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet{pattern}'")
        got = QUERIES[name](spark, at)
        want = con.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


