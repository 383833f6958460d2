"""Catalogue rows from decoded file records.

A record is a base record or an extension of one (base > 0). It is in use or not, is a directory or
not, and has names and data streams. Names of a base that did not fit lie in its extensions; one join
by record number brings them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotInvalid

#: namespace: 0 POSIX, 1 Win32, 2 DOS alone, 3 Win32 and DOS; a stream without a name is the file's content
RECORDS = "record long, sequence int, in_use boolean, is_dir boolean, base long, names array<struct<namespace:int,parent_frn:long,name:string>>, streams array<struct<name:string,size:long>>, mtime_secs long, attributes long"
#: Records below it are the volume's own; the root is one of them.
FIRST_RECORD = 24
ROOT_RECORD, EXTEND_RECORD = 5, 11


def searchable(records: DataFrame) -> DataFrame:
    """Records in use, without the volume's own files but the root and the extension directory."""
    own = (F.col("record") < FIRST_RECORD) & ~F.col("record").isin(ROOT_RECORD, EXTEND_RECORD)
    return records.where(F.col("in_use") & ~own)


def deferred_names(records: DataFrame) -> DataFrame:
    """Base records with the names of their extensions added."""
    used = searchable(records)
    more = used.where("base > 0").groupBy(F.col("base").alias("record")).agg(F.flatten(F.collect_list("names")).alias("more"))
    base = used.where("base = 0").join(more, "record", "left")
    return base.withColumn("names", F.concat("names", F.coalesce("more", F.array().cast("array<struct<namespace:int,parent_frn:long,name:string>>")))).drop("more")


def content_size(is_dir="is_dir", streams="streams"):
    """Size of the stream without a name; 0 for directories and files without one."""
    content = F.filter(streams, lambda s: s["name"] == "")
    return F.when(F.col(is_dir), 0).otherwise(F.coalesce(F.get(content, F.lit(0))["size"], F.lit(0))).cast("long")


def link_rows(records: DataFrame, strict: bool = True) -> DataFrame:
    """record, frn, parent_frn, name, is_dir, size, mtime_secs: a row for each name but those of DOS alone.

    strict: a name of an unknown namespace, or a second content stream, raises SnapshotInvalid.
    """
    whole = deferred_names(records)
    unknown = F.exists("names", lambda n: ~n["namespace"].between(0, 3))
    twice = F.size(F.filter("streams", lambda s: s["name"] == "")) > 1
    if strict and not whole.where(unknown | twice).isEmpty():
        raise SnapshotInvalid("corrupt records")
    frn = F.shiftleft(F.col("sequence").cast("long"), 48).bitwiseOR(F.col("record"))
    rows = whole.where(~unknown & ~twice).select("record", frn.alias("frn"), "is_dir", content_size().alias("size"), "mtime_secs", F.explode("names").alias("n"))
    return rows.where("n.namespace <> 2").select("record", "frn", F.col("n.parent_frn").alias("parent_frn"), F.col("n.name").alias("name"), "is_dir", "size", "mtime_secs")
