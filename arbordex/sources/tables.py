"""Catalogue volumes made from the driver's tables.

C: regions, nations and customers as directories, orders as files; D: documents by source and
language; E: pages by host; F: parts as objects with one link in each order that has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import make_frn
from ..operators import search, tree
from ..operators.pages import StoredOrders
from ..operators.ranks import number
from ..operators.search import Catalogue

#: The label and order of each volume.
VOLUMES = {"C:": 0, "D:": 1, "E:": 2, "F:": 3}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp without zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return (days.cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def rows(df: DataFrame, volume: str, record: Column, parent: Column | None, name: Column, is_dir: bool, size: Column | None = None, mtime: Column | None = None, hidden: Column | None = None, system: Column | None = None, entry_id: Column | None = None) -> DataFrame:
    """Entries of the given records; without entry_id the record number is it."""
    no = F.lit(False)
    return df.select(
        F.lit(volume).alias("volume"),
        F.lit(VOLUMES[volume]).alias("volume_ord"),
        (record if entry_id is None else entry_id).cast("long").alias("entry_id"),
        make_frn(1, record).alias("frn"),
        (F.lit(None).cast("long") if parent is None else make_frn(1, parent)).alias("parent_frn"),
        name.alias("name"),
        F.lit(is_dir).alias("is_dir"),
        (no if hidden is None else hidden).alias("hidden"),
        (no if system is None else system).alias("system"),
        F.lit(False).alias("reparse"),
        F.lit(False).alias("tombstone"),
        (F.lit(0) if size is None else size).cast("long").alias("size"),
        (F.lit(0) if mtime is None else mtime).cast("long").alias("mtime_secs"),
    )


def _root(spark: SparkSession, volume: str) -> DataFrame:
    return rows(spark.range(1), volume, F.lit(tree.ROOT_RECORD), None, F.lit(volume), True)


def _numbered(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values with n, their rank from 1."""
    return number(df.select(*columns).distinct(), [F.col(c) for c in columns], "n").withColumn("n", F.col("n") + 1)


def volume_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    root = F.lit(tree.ROOT_RECORD)
    ending = F.when(F.col("o_orderstatus") == "O", "txt").when(F.col("o_orderstatus") == "F", "PDF").otherwise("dll")
    parts = [
        _root(spark, "C:"),
        rows(region, "C:", F.col("r_regionkey") + 1000, root, F.col("r_name"), True, hidden=F.col("r_name") == "MIDDLE EAST"),
        rows(nation, "C:", F.col("n_nationkey") + 2000, F.col("n_regionkey") + 1000, F.col("n_name"), True, system=F.col("n_nationkey") == 7),
        rows(customer, "C:", F.col("c_custkey") + 1_000_000, F.col("c_nationkey") + 2000, F.col("c_name"), True),
        rows(orders, "C:", F.col("o_orderkey") + 1_000_000_000, F.col("o_custkey") + 1_000_000, F.concat(F.lit("Order_"), F.col("o_orderkey").cast("string"), F.lit("."), ending), False, size=F.round(F.col("o_totalprice") * 100), mtime=seconds(F.col("o_orderdate"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def volume_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), "n_chars")
    sources, langs = _numbered(docs, "source"), _numbered(docs, "source", "lang")
    placed = docs.join(langs, ["source", "lang"])
    in_source = langs.withColumnRenamed("n", "ln").join(sources, "source")
    parts = [
        _root(spark, "D:"),
        rows(sources, "D:", F.col("n") + 1000, F.lit(tree.ROOT_RECORD), F.col("source"), True),
        rows(in_source, "D:", F.col("ln") + 100_000, F.col("n") + 1000, F.col("lang"), True),
        rows(placed, "D:", F.col("doc_id") + 1_000_000_000, F.col("n") + 100_000, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")), False, size=F.col("n_chars")),
    ]
    return reduce(DataFrame.unionByName, parts)


def volume_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    leaf = F.regexp_extract("url", "^[a-z]+://[^/?#]*/(.*)$", 1)
    pages = pages.select("page_id", host.alias("host"), F.translate(leaf, "/\\", "__").alias("leaf"), F.coalesce(F.length("html"), F.lit(0)).alias("chars"))
    hosts = _numbered(pages, "host")
    name = F.concat(F.when(F.col("leaf") == "", "index").otherwise(F.col("leaf")), F.lit("_"), F.col("page_id").cast("string"), F.lit(".HTML"))
    parts = [
        _root(spark, "E:"),
        rows(hosts, "E:", F.col("n") + 1000, F.lit(tree.ROOT_RECORD), F.col("host"), True),
        rows(pages.join(hosts, "host"), "E:", F.col("page_id") + 1_000_000_000, F.col("n") + 1000, name, False, size=F.col("chars")),
    ]
    return reduce(DataFrame.unionByName, parts)


def volume_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard links: a part's object has one row for each order that lists it."""
    links = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    part = read(spark, sf_dir, "part")
    parents = links.select("l_orderkey").distinct()
    link_id = F.lit(10**12) + F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")
    placed = links.join(part, F.col("l_partkey") == F.col("p_partkey"))
    parts = [
        _root(spark, "F:"),
        rows(parents, "F:", F.col("l_orderkey") + 1_000_000_000, F.lit(tree.ROOT_RECORD), F.concat(F.lit("Order_"), F.col("l_orderkey").cast("string")), True),
        rows(placed, "F:", F.col("p_partkey") + 5_000_000_000, F.col("l_orderkey") + 1_000_000_000, F.col("p_name"), False, size=F.round(F.col("p_retailprice") * 100), entry_id=link_id),
    ]
    return reduce(DataFrame.unionByName, parts)


_MAKERS = {"C:": volume_c, "D:": volume_d, "E:": volume_e, "F:": volume_f}


def entries(spark: SparkSession, sf_dir: str, volumes: tuple[str, ...] = ("C:", "D:", "E:")) -> DataFrame:
    return reduce(DataFrame.unionByName, [_MAKERS[v](spark, sf_dir) for v in volumes])


def build(raw: DataFrame, strict: bool = True) -> Catalogue:
    return search.build(raw, strict)


_built: dict[tuple, Catalogue] = {}


def catalogue(spark: SparkSession, sf_dir: str, volumes: tuple[str, ...] = ("C:", "D:", "E:")) -> Catalogue:
    """The catalogue of a folder of tables; built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, volumes)
    if key not in _built:
        _built[key] = build(entries(spark, sf_dir, volumes))
    return _built[key]


_orders: dict[tuple, StoredOrders] = {}


def orders(spark: SparkSession, sf_dir: str, volumes: tuple[str, ...] = ("C:", "D:", "E:")) -> StoredOrders:
    """The orders of that catalogue; each is stored at its first use."""
    key = (spark.sparkContext.applicationId, sf_dir, volumes)
    if key not in _orders:
        _orders[key] = StoredOrders(catalogue(spark, sf_dir, volumes))
    return _orders[key]
