"""Joins of a catalogue's entries with keys: objects, links, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import record
from .statistics import live

_LINK = ["frn", "parent_frn", "name"]


def links_of_records(entries: DataFrame, records: DataFrame) -> DataFrame:
    """The live links of the objects whose record numbers are asked for (a column named record)."""
    return live(entries).withColumn("record", record(F.col("frn"))).join(records.select("record").distinct(), "record", "left_semi")


def known_links(entries: DataFrame, held: DataFrame) -> DataFrame:
    """entries with found: whether held has a link of the same object, parent and name."""
    known = held.select(*_LINK).distinct().withColumn("found", F.lit(True))
    return entries.join(known, _LINK, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_distinct_names(entries: DataFrame, test: Column) -> DataFrame:
    """The entries whose folded name passes a dear test, which sees each spelling once."""
    hit = entries.select("folded").distinct().where(test)
    return entries.join(hit, "folded", "left_semi")
