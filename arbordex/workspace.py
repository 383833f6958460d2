"""Tables that are written once and read again."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


class NoSharedFolder(RuntimeError):
    """A cluster's session names no folder that the driver and all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset and the master is local, a temporary folder of this process.

    On a cluster each executor would write its part to a disk of its own, so an unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="arbordex-")
    return _own_dirs[app]


def drop_at_end(spark: SparkSession, path: str) -> str:
    """path, which the driver's JVM deletes when it ends; what a killed driver leaves is the folder's owner's to clean."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_now(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables whose owner is done with them; a path that is gone already is none."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Lists that note the tables written within open scopes of a thread, the innermost last.
_scopes = threading.local()


@contextmanager
def owned() -> Iterator[list[str]]:
    """A scope whose materialized tables are listed, so that their owner can delete them."""
    made: list[str] = []
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append(made)
    try:
        yield made
    finally:
        stack.pop()


def temporary_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for the time of this application."""
    return f"{shared_dir(spark)}/arbordex-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back; cuts the lineage."""
    spark = df.sparkSession
    path = temporary_path(spark, label)
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(drop_at_end(spark, path))
