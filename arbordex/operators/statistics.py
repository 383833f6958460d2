"""Figures of a catalogue: names, dictionaries, storage, latencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import number, running_sums

GIB4 = (1 << 32) - 1


def live(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("tombstone"))


def _ratio(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two single rows as one."""
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")


def exact_percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row; each value is that at place floor((n - 1) * share) of the sorted column, without interpolation; 0 of no rows.

    The counts of the distinct values are summed over ranges of values, so no task sees more than its
    range, whatever the number of distinct values is. Nulls stand before all values and are none of them.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running_sums(counts, [F.col("v")], before=F.col("c"))
    n = ranked.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    picks = [F.coalesce(F.min(F.when(F.col("before") + F.col("c") > math.floor((n - 1) * p), F.col("v"))), F.lit(0)).cast("long").alias(name) for name, p in shares.items()]
    return ranked.agg(*picks, F.coalesce(F.max("v"), F.lit(0)).cast("long").alias("max"))


def name_statistics(entries: DataFrame) -> DataFrame:
    """One row: live, fold_identical, ratios of unique spellings, lengths in bytes, large sizes."""
    rows = live(entries).select("name", "folded", "size", F.octet_length("name").alias("len"))
    n = F.count(F.lit(1))
    sums = rows.agg(
        n.alias("live"),
        F.count_if(F.col("name") == F.col("folded")).alias("fold_identical"),
        F.count_distinct("name").alias("unique_names"),
        F.count_distinct("folded").alias("unique_folded"),
        _ratio(F.coalesce(F.sum("len"), F.lit(0)), n).alias("mean"),
        F.count_if(F.col("size") >= GIB4).alias("size_ge_4gib"),
    )
    lengths = exact_percentiles(rows, "len", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    f = _ratio(F.col("fold_identical"), F.col("live"))
    return _beside(sums, lengths).select(
        "live", "fold_identical", f.alias("fold_identical_ratio"), _ratio(F.col("unique_names"), F.col("live")).alias("unique_name_ratio"),
        _ratio(F.col("unique_folded"), F.col("live")).alias("unique_folded_ratio"), "mean", "p50", "p90", "p99", "max", "size_ge_4gib",
    )


def trigram_estimate(entries: DataFrame) -> DataFrame:
    """One row: distinct byte trigrams of folded names, postings, bytes of an index, bytes per entry."""
    hexed = F.hex(F.encode("folded", "UTF-8"))
    places = F.expr("sequence(1, length(h) div 2 - 2)")
    names = live(entries).groupBy("folded").agg(F.count(F.lit(1)).alias("c"))  # each spelling is cut once
    rows = names.select("c", hexed.alias("h"))
    grams = rows.where(F.length("h") >= 6).select("c", F.explode(F.transform(places, lambda i: F.substring("h", i * 2 - 1, F.lit(6)))).alias("g"))
    per = grams.groupBy("g").agg(F.sum("c").alias("c"))
    sums = per.agg(F.count(F.lit(1)).alias("distinct_trigrams"), F.coalesce(F.sum("c"), F.lit(0)).alias("postings"))
    total = F.col("distinct_trigrams") * 11 + F.expr("postings * 3 div 2")
    return _beside(sums, live(entries).agg(F.count(F.lit(1)).alias("live"))).select("distinct_trigrams", "postings", total.alias("total_bytes"), _ratio(total, F.col("live")).alias("per_entry"))


def dictionary_estimate(entries: DataFrame, column: str = "folded") -> DataFrame:
    """One row: distinct spellings and their bytes against the bytes of all names."""
    rows = live(entries).groupBy(column).agg(F.count(F.lit(1)).alias("c")).select("c", F.octet_length(column).cast("long").alias("len"))
    sums = rows.agg(F.count(F.lit(1)).alias("distinct_names"), F.coalesce(F.sum("len"), F.lit(0)).alias("dict_bytes"), F.coalesce(F.sum(F.col("c") * F.col("len")), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("c"), F.lit(0)).alias("live"))
    at_rest = (F.col("dict_bytes") - F.col("logical_bytes") - 2 * F.col("live") + 6 * F.col("distinct_names")) / F.greatest(F.col("live"), F.lit(1))
    return sums.select("*", at_rest.alias("net_at_rest"), (at_rest + 16 * F.col("distinct_names") / F.greatest(F.col("live"), F.lit(1))).alias("net_resident"))


def original_estimate(entries: DataFrame) -> DataFrame:
    """One row: spellings that folding changes, against the bytes of all such names."""
    n = live(entries).agg(F.count(F.lit(1)).alias("all_live"))
    other = live(entries).where(F.col("name") != F.col("folded"))
    d = dictionary_estimate(other, "name").select(F.col("live").alias("differing"), "distinct_names", "dict_bytes", F.col("logical_bytes").alias("orig_logical"))
    return _beside(d, n).select("*", ((F.col("dict_bytes") - F.col("orig_logical")) / F.greatest("all_live", F.lit(1))).alias("net"))


def index_statistics(entries: DataFrame) -> DataFrame:
    """One row per volume: rows, live, tombstones, bytes of names, share of tombstones (0 for no rows)."""
    n, dead = F.count(F.lit(1)), F.count_if("tombstone")
    return entries.groupBy("volume").agg(
        n.alias("n_rows"), (n - dead).alias("live"), dead.alias("tombstones"), F.count_if("is_dir").alias("directories"),
        F.sum(F.octet_length("name")).alias("name_bytes"), F.sum(F.when(F.col("name") != F.col("folded"), F.octet_length("name")).otherwise(0)).alias("orig_bytes"),
        _ratio(dead, n).alias("tombstone_ratio"),
    )


def latency_histogram(df: DataFrame, micros: Column) -> DataFrame:
    """bucket, n, upper: values in [2^bucket, 2^(bucket + 1)) microseconds, the last of 32 takes the rest."""
    value = F.greatest(micros.cast("long"), F.lit(1))
    bucket = F.least(F.length(F.bin(value)) - 1, F.lit(31))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("upper", F.expr("shiftleft(1L, bucket + 1)"))


def histogram_percentile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the upper bound of the bucket that holds the value at ceil(n * share)."""
    seen = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # 32 rows at most
    ranked = histogram.select("upper", seen.alias("seen"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return ranked.where(F.col("seen") >= F.ceil(F.col("total") * F.lit(share))).agg(F.coalesce(F.min("upper"), F.lit(0)).alias("percentile_us"))


def name_ids(entries: DataFrame) -> DataFrame:
    """folded, first_id, name_id: distinct folded names numbered from 0 by the entry that shows them first."""
    firsts = live(entries).groupBy("folded").agg(F.min(F.struct("volume_ord", "entry_id")).alias("first"))
    ordered = number(firsts, [F.col("first.volume_ord"), F.col("first.entry_id")], "name_id")
    return ordered.select("folded", F.col("first.entry_id").alias("first_id"), "name_id")


def first_links(entries: DataFrame) -> DataFrame:
    """One row for each (volume, frn, parent_frn, name): that with the least entry_id.

    Rows are dealt out by the link first: else each task sorts what it has made of its input, whatever that
    is, before the sort that counts.
    """
    link = "volume", "frn", "parent_frn", "name"
    keep = F.row_number().over(Window.partitionBy(*link).orderBy("entry_id"))
    return entries.repartition(*link).withColumn("__n", keep).where("__n = 1").drop("__n")
