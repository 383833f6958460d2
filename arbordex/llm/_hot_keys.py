"""Left joins whose key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many rows on, and from 1 / MOST_HOT of all rows: there are MOST_HOT of them at most.
LEAST_HOT, MOST_HOT = 10_000, 100_000


def hot_keys(counted: DataFrame, key: str, n_rows: int) -> DataFrame:
    """The hot keys of a table (key, n) that tells how often each stands in n_rows rows."""
    return counted.where(F.col("n") > max(LEAST_HOT, n_rows // MOST_HOT)).select(key)


def left_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows with the columns of table, which has one row for a key at most.

    Rows of hot keys, of which hot has MOST_HOT at most, stay where they are and meet the table's rows
    of these keys, which are as few, in a broadcast; only the others are shuffled by the key.
    """
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    few = table.join(F.broadcast(hot), key, "left_semi")
    at_home = marked.where("__hot").drop("__hot").join(F.broadcast(few), key, "left")
    return at_home.unionByName(marked.where("__hot is null").drop("__hot").join(table, key, "left"))
