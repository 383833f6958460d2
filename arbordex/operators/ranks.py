"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialize


def number(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """rows with their place in the order, from 0.

    The sort deals ranges to partitions; rows know their partition and their place in it, and the
    counts of the partitions, one row each, give what comes before.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = materialize(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", inside), "ordered")
    counts = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return fixed.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")


def running_sums(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with, for each name, the sum of its column over the rows before, in the order."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = materialize(rows.orderBy(*order).withColumns(sums).withColumn("__part", F.spark_partition_id()).withColumn("__at", inside), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = fixed.groupBy("__part").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = parts.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = fixed.join(F.broadcast(offsets), "__part")
    whole = {c: F.col(f"__{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}
    return placed.withColumns(whole).drop("__part", "__at", *[f"__{c}" for c in sums])
