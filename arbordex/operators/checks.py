"""Checks that a catalogue is sound; each gives the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotInvalid
from ..functions.scalars import record
from .statistics import live


def bad_parents(entries: DataFrame) -> DataFrame:
    """Live rows below a parent that is missing, dead or no directory."""
    dirs = live(entries).where("is_dir").select(F.col("volume").alias("b_volume"), F.col("frn").alias("b_frn"))
    return live(entries).where("parent_frn is not null").join(dirs, (F.col("volume") == F.col("b_volume")) & (F.col("parent_frn") == F.col("b_frn")), "left_anti")


def repeated_links(entries: DataFrame) -> DataFrame:
    """(volume, frn, parent_frn, name, n) of live links that stand more than once."""
    return live(entries).groupBy("volume", "frn", "parent_frn", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mixed_generations(entries: DataFrame) -> DataFrame:
    """(volume, record, n) of record numbers under which live objects of several sequences stand."""
    return live(entries).groupBy("volume", record(F.col("frn")).alias("record")).agg(F.count_distinct("frn").alias("n")).where("n > 1")


def repeated_directories(entries: DataFrame) -> DataFrame:
    """(volume, frn, n) of directories with several rows, or with a file's row beside theirs."""
    return live(entries).groupBy("volume", "frn").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_dir").alias("any_dir")).where("n > 1 and any_dir").select("volume", "frn", "n")


CHECKS = {"bad_parents": bad_parents, "repeated_links": repeated_links, "mixed_generations": mixed_generations, "repeated_directories": repeated_directories}


def require_sound(entries: DataFrame) -> None:
    for name, check in CHECKS.items():
        if not check(entries).isEmpty():
            raise SnapshotInvalid(name)
