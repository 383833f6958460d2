"""What metadata look-ups gave, as tables that grow while a store is followed.

Sizes and complete link sets lie in buckets by record number, each with the number of the look-up that
gave it (seen); the highest number of an object counts. A batch reads the buckets of its own objects
alone. Who looks things up appends, and a stream sees what was appended before each of its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import bucket_of

STATS = "frn long, size long, mtime_secs long"
#: state: present, gone or failed; a missing row is a failed look-up
LINKS = "frn long, parent_frn long, name string, state string"


class MetadataTables:
    """Look-ups under path, in the given number of buckets (as many as when the tables were begun).

    Rows without frn are none. Of sizes with one number for an object the largest (size, mtime_secs)
    counts; rows of links with one number are one set.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def put(self, seen: int, stats: DataFrame | None = None, links: DataFrame | None = None) -> None:
        """Append what look-up number seen gave; putting the same rows again changes nothing."""
        for kind, rows, columns in (("stats", stats, STATS), ("links", links, LINKS)):
            if rows is not None:
                placed = rows.where("frn is not null").select(*_names(columns), F.lit(seen).cast("long").alias("seen"), bucket_of(F.col("frn"), self.buckets).alias("bucket"))
                placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{kind}")

    def _folders(self, kind: str, touched: list[int]) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = folder(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [p for b in touched if fs.exists(folder(p := f"{self.path}/{kind}/bucket={b}"))]

    def _read(self, kind: str, columns: str, touched: list[int]) -> DataFrame:
        found = self._folders(kind, touched)
        schema = f"{columns}, seen long"
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def look_up(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(STATS, LINKS) of the objects of keys (frn), as they were seen last."""
        keys = keys.select("frn").distinct()
        touched = [r[0] for r in keys.where("frn is not null").select(bucket_of(F.col("frn"), self.buckets)).distinct().collect()]  # at most a row for each bucket
        stats = self._read("stats", STATS, touched).join(keys, "frn", "left_semi")
        stats = stats.groupBy("frn").agg(F.max(F.struct("seen", "size", "mtime_secs")).alias("s")).select("frn", "s.size", "s.mtime_secs")
        if not self._folders("links", touched):
            return stats, self.spark.createDataFrame([], LINKS)
        links = self._read("links", LINKS, touched).join(keys, "frn", "left_semi")
        last = links.groupBy("frn").agg(F.max("seen").alias("seen"))
        return stats, links.join(last, ["frn", "seen"]).select(*_names(LINKS)).distinct()

    def merged(self, path: str) -> MetadataTables:
        """Tables under another path that hold what counts alone, for when many look-ups have been appended."""
        out = MetadataTables(self.spark, path, self.buckets)
        every = list(range(self.buckets))
        stats, links = self._read("stats", STATS, every), self._read("links", LINKS, every)
        stats = stats.groupBy("frn").agg(F.max(F.struct("seen", "size", "mtime_secs")).alias("s")).select("frn", "s.size", "s.mtime_secs", "s.seen")
        links = links.join(links.groupBy("frn").agg(F.max("seen").alias("seen")), ["frn", "seen"]).distinct()
        for kind, rows in (("stats", stats), ("links", links)):
            rows.withColumn("bucket", bucket_of(F.col("frn"), self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{kind}")
        return out


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]
