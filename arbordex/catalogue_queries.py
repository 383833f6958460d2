"""Registered queries of the catalogue engine: one for each operator, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue_sql as sql
from .engine import Engine
from .functions import fold, highlight, literals, scalars, wtf8
from .operators import checks, lookups, search, statistics, tree
from .operators.ranks import number
from .operators.search import Catalogue
from .operators.stored import StoredCatalogue
from .plans.compiler import Options, compile_query, validate
from .plans.focus import focused
from .plans.implication import subsumes
from .plans import regexes
from .sources import journal, journal_source, records, tables
from .sources.metadata import MetadataTables
from .sources.snapshots import SnapshotStore, names
from .streaming import apply, decisions, tail
from .streaming.debounce import debounced
from .workspace import drop_at_end, materialize, temporary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries over all rows without SQL; the tests check them by brute force.
BY_TEST: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ALL = Options(include_hidden_system=True)


def register(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


# --- filters: a query text each, and the condition that it means

_LIST = "volume", "entry_id", "name"
_FILTERS = {
    "flt_name_contains": ("order_12", Options(), "contains(low, 'order_12')"),
    "flt_name_prefix": ("customer#00000001*", Options(), "starts_with(low, 'customer#00000001')"),
    "flt_name_suffix": ("*7.pdf", Options(), "ends_with(low, '7.pdf')"),
    "flt_wild_inner": ("*_99*", Options(), "contains(low, '_99')"),
    "flt_wild_general": ("order_?5*.t?t", Options(), "regexp_full_match(low, 'order_.5.*\\.t.t', 's')"),
    "flt_path_contains": ("europe\\nation_1", Options(), "contains(lower(path), 'europe' || chr(92) || 'nation_1')"),
    "flt_path_wild": ("path:asia*customer#00000001?\\order", Options(), "regexp_matches(lower(path), 'asia.*customer#00000001.\\\\order', 's')"),
    "flt_regex": ('regex:"^Order_[0-9]{3}\\.(PDF|txt)$"', Options(), "regexp_matches(name, '^Order_[0-9]{3}\\.(PDF|txt)$', 's')"),
    "flt_regex_whole": ("^order_1.*7\\.(pdf|dll)$", Options(whole_regex="name"), "regexp_matches(name, '^order_1.*7\\.(pdf|dll)$', 'is')"),
    "flt_regex_whole_path": ("africa.*order_[0-9]5\\.", Options(whole_regex="path"), "regexp_matches(path, 'africa.*order_[0-9]5\\.', 'is')"),
    "flt_ext": ("ext:.pdf;HTML", Options(), "NOT is_dir AND split_part(low, '.', -1) IN ('pdf', 'html') AND contains(low, '.')"),
    "flt_size": ("size:100kb..1mb", Options(), "NOT is_dir AND size BETWEEN 102400 AND 1048576"),
    "fn_size_literal": ("size:>=1.5mb size:<3e7", Options(), "NOT is_dir AND size >= 1572864 AND size <= 29999999"),
    "flt_mtime": ("dm:1995-03..1996", Options(), "mtime_secs >= 794016000 AND mtime_secs < 852076800"),
    "fn_date_literal": ("dm:<1993/02 | dm:>=1998-01-15", Options(), "mtime_secs < 728524800 OR mtime_secs >= 884822400"),
    "flt_isdir": ("folder:nation_1", Options(), "is_dir AND contains(low, 'nation_1')"),
    "flt_not": ("!ext:txt !folder: !!order_1 !size:>1mb", Options(), "NOT (NOT is_dir AND low LIKE '%.txt') AND NOT is_dir AND contains(low, 'order_1') AND NOT size > 1048576"),
    "flt_and": ("ext:dll size:>3mb 7 dm:1996", Options(), "NOT is_dir AND ends_with(low, '.dll') AND size > 3145728 AND contains(low, '7') AND mtime_secs >= 820454400 AND mtime_secs < 852076800"),
    "flt_or": ("ext:dll size:>3mb | folder: nation_1 | doc_77", Options(), "NOT is_dir AND ends_with(low, '.dll') AND size > 3145728 OR is_dir AND contains(low, 'nation_1') OR contains(low, 'doc_77')"),
    "flt_phrase": ('"order_5|" | "Order_77" "ext:pdf"|"Customer#00000012"', Options(), "contains(name, 'Customer#00000012')"),
    "flt_match_all": ("", Options(), "true"),
    "q_parse": ("order_1 | ", Options(), "true"),
    "q_atom": ('path:"europe\\nation" "_1"', Options(), "contains(lower(path), 'europe' || chr(92) || 'nation') AND contains(low, '_1')"),
    "q_terms": ("E:\\ EXT:html 12:30 | FILE: doc_5", Options(), "NOT is_dir AND contains(low, 'doc_5')"),
    "q_focused": (focused("order_1 size:>1mb | path:asia order_2"), Options(), "contains(low, 'order_1') AND NOT is_dir AND size > 1048576 AND split_part(low, '.', -1) IN ('txt', 'pdf') OR contains(lower(path), 'asia') AND contains(low, 'order_2') AND NOT is_dir AND split_part(low, '.', -1) IN ('txt', 'pdf')"),
}


def _filter_query(text: str, options: Options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.filtered(tables.catalogue(spark, sf_dir), compile_query(text, options)).select(*_LIST)

    return run


for _name, (_text, _options, _condition) in _FILTERS.items():
    register(_name, sql.matching(_condition))(_filter_query(_text, _options))


@register("flt_visibility", sql.matching("true", True, "volume, entry_id, ex AS is_excluded"))
def _visibility(spark, sf_dir):
    return search.filtered(tables.catalogue(spark, sf_dir), compile_query("", ALL)).select("volume", "entry_id", "is_excluded")


@register("flt_live", sql.matching("record % 7 <> 0 AND contains(low, '1')"))
def _live(spark, sf_dir):
    c = tables.catalogue(spark, sf_dir)
    dead = Catalogue(c.entries.withColumn("tombstone", F.col("entry_id") % 7 == 0), c.paths)
    return search.filtered(dead, compile_query("1")).select(*_LIST)


@register("opt_case", f"{sql.BASE}SELECT m.mode, volume, entry_id FROM e, (VALUES ('smart'), ('insensitive'), ('sensitive')) m(mode) WHERE NOT ex AND CASE mode WHEN 'insensitive' THEN contains(low, 'order_7') ELSE contains(name, 'Order_7') END")
def _case(spark, sf_dir):
    c = tables.catalogue(spark, sf_dir)
    parts = [search.filtered(c, compile_query("Order_7", Options(case=m))).select(F.lit(m).alias("mode"), "volume", "entry_id") for m in ("smart", "insensitive", "sensitive")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


#: What a query of each order's figures is, by its key; every second kind is refused.
_GIVEN = "CASE o_orderkey % 8 WHEN 0 THEN 'size:>' || o_orderkey || 'kb' WHEN 1 THEN 'size:' || o_orderkey || 'pints' WHEN 2 THEN 'dm:' || day WHEN 3 THEN 'dm:' || day || '-00' WHEN 4 THEN '\"' || o_orderpriority || '\" ext:a;b' WHEN 5 THEN '\"' || o_orderpriority WHEN 6 THEN 'regex:^' || o_orderstatus || '[0-9]{2,}' ELSE 'regex:' || o_orderstatus || '[' END"


@register("opt_validate", f"WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) SELECT o_orderkey, {_GIVEN} AS query, o_orderkey % 2 = 0 AS valid FROM o")
def _validate(spark, sf_dir):
    checked = F.pandas_udf(lambda part: part.map(validate), "boolean")
    orders = tables.read(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select("o_orderkey", F.expr(_GIVEN).alias("query")).withColumn("valid", checked("query"))


@register("join_subsume", sql.matching("contains(low, 'order_12') AND NOT is_dir AND ends_with(low, '.pdf')"))
def _subsume(spark, sf_dir):
    c = tables.catalogue(spark, sf_dir)
    first, then = compile_query("order_1"), compile_query("order_12 ext:pdf")
    if not subsumes(first, then):
        raise AssertionError("the first query covers the second")
    return search.filtered(Catalogue(materialize(search.filtered(c, first), "held"), c.paths), then).select(*_LIST)


# --- projections, orders, pages

_REF = "volume_ord * 4294967296 + entry_id AS entry_ref, frn, size, CASE WHEN mtime_secs = 0 THEN 0 ELSE (mtime_secs + 11644473600) * 10000000 END AS mtime, CASE WHEN is_dir THEN 1 ELSE 0 END AS flags, name, parent_path"


@register("proj_row", sql.matching("contains(low, '9')", False, _REF))
def _row(spark, sf_dir):
    c = tables.catalogue(spark, sf_dir)
    return search.projected(search.filtered(c, compile_query("9")), c.paths)


_ORDERS = {
    "sort_name": ("order_", Options(), "low, volume_ord, entry_id"),
    "sort_size": ("1", Options(sort="size"), "size, volume_ord, entry_id"),
    "sort_mtime": ("", Options(sort="mtime"), "mtime_secs, volume_ord, entry_id"),
    "sort_desc": ("1", Options(sort="size", desc=True), "size DESC, volume_ord, entry_id DESC"),
    "sort_kway": ("e", Options(sort="mtime", desc=True), "mtime_secs DESC, volume_ord, entry_id DESC"),
}


def _order_query(text: str, options: Options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.orders(spark, sf_dir).hits(text, options).positions().select("pos", *_LIST)

    return run


for _name, (_text, _options, _by) in _ORDERS.items():
    _where = f"contains(low, '{_text}')"
    register(_name, f"{sql.BASE}SELECT row_number() OVER (ORDER BY {_by}) - 1 AS pos, volume, entry_id, name FROM e WHERE NOT ex AND {_where}")(_order_query(_text, _options))


@register("lim_page", f"{sql.BASE}, n AS (SELECT *, row_number() OVER (ORDER BY size DESC, volume_ord, entry_id DESC) - 1 AS pos FROM e WHERE NOT ex AND NOT is_dir) SELECT pos, {_REF} FROM n WHERE pos BETWEEN 100 AND 163")
def _page(spark, sf_dir):
    return tables.orders(spark, sf_dir).hits("file:", Options(sort="size", desc=True)).page(100, 64)


@register("lim_topk", f"{sql.BASE}, n AS (SELECT *, row_number() OVER (ORDER BY low, volume_ord, entry_id) - 1 AS pos FROM e WHERE NOT ex AND NOT is_dir AND ends_with(low, '.pdf')) SELECT pos, {_REF} FROM n WHERE pos < 20")
def _topk(spark, sf_dir):
    c = tables.catalogue(spark, sf_dir)
    return search.projected(search.top(c, "ext:pdf", 20), c.paths)


_SAME = {"same": ("order_1", "order_1 file:", Options(), Options()), "narrower": ("order_1", "order_11", Options(), Options()), "other order": ("order_1", "order_1", Options(), Options(sort="size", desc=True)), "more": ("order_11", "order_1", Options(), Options())}
_SAME_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS case_name, (SELECT count(*) FROM (SELECT row_number() OVER (ORDER BY low, volume_ord, entry_id) AS p, volume_ord, entry_id FROM e WHERE NOT ex AND contains(low, '{a}')) x FULL JOIN "
    f"(SELECT row_number() OVER (ORDER BY {'size DESC, volume_ord, entry_id DESC' if o.desc else 'low, volume_ord, entry_id'}) AS p, volume_ord, entry_id FROM e WHERE NOT ex AND contains(low, '{b.split()[0]}'){' AND NOT is_dir' if 'file:' in b else ''}) y "
    "ON x.p = y.p AND x.volume_ord = y.volume_ord AND x.entry_id = y.entry_id WHERE x.p IS NULL OR y.p IS NULL) = 0 AS unchanged"
    for name, (a, b, _, o) in _SAME.items()
)


@register("res_unchanged", f"{sql.BASE}{_SAME_SQL}")
def _unchanged(spark, sf_dir):
    """Whether two searches list the same entries in the same order."""
    orders = tables.orders(spark, sf_dir)
    rows = [(name, search.unchanged(orders.hits(a, x).positions(), orders.hits(b, y).positions())) for name, (a, b, x, y) in _SAME.items()]
    return spark.createDataFrame(rows, "case_name string, unchanged boolean")


@register("res_stale", f"{sql.BASE}, n AS (SELECT *, row_number() OVER (ORDER BY low, volume_ord, entry_id) - 1 AS pos FROM e WHERE NOT ex AND contains(low, 'order_')) SELECT volume, entry_id, pos FROM n WHERE pos < 64 AND record % 5 = 0")
def _stale(spark, sf_dir):
    """Rows of a page that are no longer live."""
    c = tables.catalogue(spark, sf_dir)
    now = statistics.live(c.entries.withColumn("tombstone", F.col("entry_id") % 5 == 0)).select("volume", "entry_id")
    return search.top(c, "order_", 64).select("volume", "entry_id", "pos").join(now, ["volume", "entry_id"], "left_anti")


# --- joins


@register("join_recursive_path", f"{sql.BASE}SELECT volume, entry_id, path, parent_path FROM e")
def _paths(spark, sf_dir):
    c = tables.catalogue(spark, sf_dir)
    return tree.with_paths(c.entries, c.paths).select("volume", "entry_id", "path", "parent_path")


@register("join_excluded_inherit", f"{sql.BASE}SELECT volume, frn, ex AS excluded FROM e WHERE is_dir")
def _excluded(spark, sf_dir):
    return tree.close_directories(tables.entries(spark, sf_dir), strict=True).select("volume", "frn", "excluded")


_CUT = "raw2 AS (SELECT * FROM raw WHERE NOT (volume = 'C:' AND record BETWEEN 2000 AND 2004)), w2 AS (SELECT volume, record, is_dir FROM raw2 WHERE parent IS NULL UNION ALL SELECT r.volume, r.record, r.is_dir FROM raw2 r JOIN w2 ON r.volume = w2.volume AND r.parent = w2.record AND w2.is_dir)"


@register("join_parent_resolve", f"WITH RECURSIVE {sql.RAW}, {_CUT} SELECT volume, record AS entry_id FROM w2")
def _resolve(spark, sf_dir):
    """Five directories are missing: their subtrees go."""
    rows = tables.entries(spark, sf_dir).where("not (volume = 'C:' and entry_id between 2000 and 2004)")
    return tree.resolve_parents(rows).select("volume", "entry_id")


@register("join_parent_synth", f"WITH RECURSIVE {sql.RAW} SELECT volume, record AS entry_id, 281474976710656 + CASE WHEN volume = 'C:' AND parent BETWEEN 2000 AND 2004 THEN 5 ELSE parent END AS parent_frn FROM raw WHERE NOT (volume = 'C:' AND record BETWEEN 2000 AND 2004)")
def _synth(spark, sf_dir):
    rows = tables.entries(spark, sf_dir).where("not (volume = 'C:' and entry_id between 2000 and 2004)")
    # odd parents carry another sequence number, and are found by their record
    other = F.when(F.col("parent_frn") % 2 == 1, F.col("parent_frn") + (1 << 48)).otherwise(F.col("parent_frn"))
    root = F.col("parent_frn") == (1 << 48 | tree.ROOT_RECORD)
    return tree.resolve_or_root(rows.withColumn("parent_frn", F.when(root, F.col("parent_frn")).otherwise(other))).select("volume", "entry_id", "parent_frn")


@register("join_topology_memo", f"{sql.BASE}SELECT entry_id, CASE WHEN record IN (2001, 2002) THEN 'C:' || chr(92) || name WHEN split_part(path, chr(92), 3) IN ('NATION_1', 'NATION_2') THEN 'C:' || substr(path, length(split_part(path, chr(92), 2)) + 4) ELSE path END AS path FROM e WHERE volume = 'C:' AND is_dir")
def _memo(spark, sf_dir):
    """Two directories contain each other: both hang at the root."""
    rows = tables.entries(spark, sf_dir, ("C:",))
    loop = F.when(F.col("entry_id") == 2001, F.lit((1 << 48) + 2002)).when(F.col("entry_id") == 2002, F.lit((1 << 48) + 2001)).otherwise(F.col("parent_frn"))
    closed = tree.close_directories(rows.withColumn("parent_frn", loop))
    return closed.select(scalars.record(F.col("frn")).alias("entry_id"), "path")


@register("join_frn_lookup", f"WITH {sql.LINKS}, want AS (SELECT 5000000000 + p_partkey AS record FROM part WHERE p_size < 10) SELECT frn, entry_id FROM links JOIN want ON frn = 281474976710656 + record")
def _lookup(spark, sf_dir):
    """Record numbers to all live links of their objects."""
    links = tables.volume_f(spark, sf_dir).where(~F.col("is_dir"))
    want = tables.read(spark, sf_dir, "part").where("p_size < 10").select((F.col("p_partkey") + 5_000_000_000).alias("record"))
    return lookups.links_of_records(links, want).select("frn", "entry_id")


@register("join_link_identity", f"WITH {sql.LINKS} SELECT entry_id, o % 3 <> 0 AS found FROM links")
def _identity(spark, sf_dir):
    """Each link by its full identity (object, parent, name), against a table that holds two thirds of them."""
    links = tables.volume_f(spark, sf_dir).where(~F.col("is_dir")).select("entry_id", "frn", "parent_frn", "name")
    held = links.where(scalars.record(F.col("parent_frn")) % 3 != 1_000_000_000 % 3)
    return lookups.known_links(links, held).select("entry_id", "found")


@register("join_name_semi", sql.matching("regexp_matches(low, 'o.*[13579]{2}\\.')"))
def _semi(spark, sf_dir):
    """The pattern runs over distinct names once, and the entries follow by a semi-join."""
    c = tables.catalogue(spark, sf_dir)
    seen = c.entries.where(~F.col("is_excluded"))
    return lookups.with_distinct_names(seen, F.rlike("folded", F.lit("o.*[13579]{2}\\."))).select(*_LIST)


_BROKEN = "raw3 AS (SELECT *, volume = 'C:' AND record BETWEEN 1000 AND 1002 AS dead FROM raw)"


@register("join_validate_anti", f"WITH RECURSIVE {sql.RAW}, {_BROKEN} SELECT 'bad_parents' AS check_name, count(*) AS n FROM raw3 c WHERE NOT dead AND parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw3 p WHERE NOT p.dead AND p.is_dir AND p.volume = c.volume AND p.record = c.parent) UNION ALL SELECT 'mixed_generations', 0 UNION ALL SELECT 'repeated_directories', 0 UNION ALL SELECT 'repeated_links', 0")
def _broken(spark, sf_dir):
    rows = tables.entries(spark, sf_dir).withColumn("tombstone", (F.col("volume") == "C:") & F.col("entry_id").between(1000, 1002))
    parts = [check(rows).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n") for name, check in checks.CHECKS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# --- aggregations


@register("agg_hits", f"{sql.BASE}SELECT count(*) AS hits FROM e WHERE NOT ex AND contains(low, 'order_1')")
def _hits(spark, sf_dir):
    return search.filtered(tables.catalogue(spark, sf_dir), compile_query("order_1")).agg(F.count(F.lit(1)).alias("hits"))


_LENS = "l AS (SELECT strlen(name) AS len, row_number() OVER (ORDER BY strlen(name)) - 1 AS i, count(*) OVER () AS n FROM e)"


def _pct(p: str) -> str:
    return f"(SELECT min(len) FILTER (WHERE i = CAST(floor((n - 1) * {p}) AS BIGINT)) FROM l)"


@register("agg_name_stats", f"{sql.BASE}, {_LENS} SELECT count(*) AS live, count(*) FILTER (WHERE name = low) AS fold_identical, count(*) FILTER (WHERE name = low) / count(*) AS fold_identical_ratio, count(DISTINCT name) / count(*) AS unique_name_ratio, count(DISTINCT low) / count(*) AS unique_folded_ratio, sum(strlen(name)) / count(*) AS mean, {_pct('0.5')} AS p50, {_pct('0.9')} AS p90, {_pct('0.99')} AS p99, max(strlen(name)) AS max, count(*) FILTER (WHERE size >= 4294967295) AS size_ge_4gib FROM e")
def _name_stats(spark, sf_dir):
    return statistics.name_statistics(tables.catalogue(spark, sf_dir).entries)


@register("agg_trigram", f"{sql.BASE}, g AS (SELECT substr(low, i, 3) AS g FROM e, range(1, strlen(low) - 1) r(i)), s AS (SELECT count(DISTINCT g) AS d, count(*) AS p FROM g) SELECT d AS distinct_trigrams, p AS postings, d * 11 + p * 3 // 2 AS total_bytes, (d * 11 + p * 3 // 2) / (SELECT count(*) FROM e) AS per_entry FROM s")
def _trigram(spark, sf_dir):
    return statistics.trigram_estimate(tables.catalogue(spark, sf_dir).entries)


@register("agg_dict_estimate", f"{sql.BASE}, d AS (SELECT low, count(*) AS c FROM e GROUP BY low), s AS (SELECT count(*) AS d, sum(strlen(low)) AS b, sum(c * strlen(low)) AS l, sum(c) AS n FROM d) SELECT d AS distinct_names, b AS dict_bytes, l AS logical_bytes, n AS live, (b - l - 2 * n + 6 * d) / n AS net_at_rest, (b - l - 2 * n + 6 * d) / n + 16 * d / n AS net_resident FROM s")
def _dict(spark, sf_dir):
    return statistics.dictionary_estimate(tables.catalogue(spark, sf_dir).entries)


@register("agg_orig_estimate", f"{sql.BASE}, d AS (SELECT name, count(*) AS c FROM e WHERE name <> low GROUP BY name), s AS (SELECT count(*) AS d, sum(strlen(name)) AS b, sum(c * strlen(name)) AS l, sum(c) AS n FROM d) SELECT n AS differing, d AS distinct_names, b AS dict_bytes, l AS orig_logical, (SELECT count(*) FROM e) AS all_live, (b - l) / (SELECT count(*) FROM e) AS net FROM s")
def _orig(spark, sf_dir):
    return statistics.original_estimate(tables.catalogue(spark, sf_dir).entries)


@register("agg_index_stats", f"{sql.BASE}SELECT volume, count(*) AS n_rows, count(*) FILTER (WHERE record % 9 <> 0) AS live, count(*) FILTER (WHERE record % 9 = 0) AS tombstones, count(*) FILTER (WHERE is_dir) AS directories, sum(strlen(name)) AS name_bytes, sum(CASE WHEN name <> low THEN strlen(name) ELSE 0 END) AS orig_bytes, count(*) FILTER (WHERE record % 9 = 0) / count(*) AS tombstone_ratio FROM e GROUP BY volume")
def _index_stats(spark, sf_dir):
    return statistics.index_statistics(tables.catalogue(spark, sf_dir).entries.withColumn("tombstone", F.col("entry_id") % 9 == 0))


@register("agg_tombstone_ratio", f"{sql.BASE}SELECT count(*) FILTER (WHERE record % 4 = 0) / count(*) AS ratio FROM e")
def _ratio(spark, sf_dir):
    rows = tables.catalogue(spark, sf_dir).entries.withColumn("tombstone", F.col("entry_id") % 4 == 0)
    return rows.agg(F.coalesce(F.try_divide(F.count_if("tombstone"), F.count(F.lit(1))), F.lit(0.0)).alias("ratio"))


_MICROS = "CAST(floor(value * 1000) AS BIGINT)"


@register("agg_histogram", f"WITH b AS (SELECT least(31, strlen(bin(greatest({_MICROS}, 1))) - 1) AS bucket FROM events) SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, CAST(2 AS BIGINT) ** (bucket + 1) AS upper FROM b GROUP BY bucket".replace("CAST(2 AS BIGINT) ** (bucket + 1)", "CAST(2 ** (bucket + 1) AS BIGINT)"))
def _histogram(spark, sf_dir):
    return statistics.latency_histogram(tables.read(spark, sf_dir, "events"), F.floor(F.col("value") * 1000))


@register("agg_histogram_percentile", f"WITH b AS (SELECT least(31, strlen(bin(greatest({_MICROS}, 1))) - 1) AS bucket FROM events), c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket), s AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS seen, sum(n) OVER () AS total FROM c) SELECT CAST(2 ** (min(bucket) + 1) AS BIGINT) AS percentile_us FROM s WHERE seen >= ceil(total * 0.9)")
def _histogram_percentile(spark, sf_dir):
    return statistics.histogram_percentile(_histogram(spark, sf_dir), 0.9)


@register("agg_bench_pctl", "WITH v AS (SELECT CAST(floor(value * 1000) AS BIGINT) AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT max(v) FILTER (WHERE i = CAST(floor((n - 1) * 0.5) AS BIGINT)) AS p50, max(v) FILTER (WHERE i = CAST(floor((n - 1) * 0.99) AS BIGINT)) AS p99, max(v) AS max FROM v")
def _bench_pctl(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").select(F.floor(F.col("value") * 1000).alias("v"))
    return statistics.exact_percentiles(rows, "v", {"p50": 0.5, "p99": 0.99})


@register("agg_dedup_names", f"{sql.BASE}, d AS (SELECT low AS folded, arg_min(entry_id, volume_ord * 1125899906842624 + entry_id) AS first_id, min(volume_ord * 1125899906842624 + entry_id) AS o FROM e GROUP BY low) SELECT folded, first_id, row_number() OVER (ORDER BY o) - 1 AS name_id FROM d")
def _dedup_names(spark, sf_dir):
    return statistics.name_ids(tables.catalogue(spark, sf_dir).entries)


@register("agg_dedup_links", f"WITH {sql.LINKS} SELECT frn, parent_frn, name, entry_id FROM links")
def _dedup_links(spark, sf_dir):
    links = tables.volume_f(spark, sf_dir).where(~F.col("is_dir"))
    later = links.withColumn("entry_id", F.col("entry_id") + 10**15)
    return statistics.first_links(later.unionByName(links)).select("frn", "parent_frn", "name", "entry_id")


@register("agg_rank_name", f"{sql.BASE}SELECT volume, entry_id, dense_rank() OVER (ORDER BY low) - 1 AS name_rank FROM e")
def _rank(spark, sf_dir):
    """The rank of a name among distinct folded names, numbered by range partitions."""
    entries = tables.catalogue(spark, sf_dir).entries
    ranks = number(entries.select("folded").distinct(), [F.col("folded")], "name_rank")
    return entries.join(ranks, "folded").select("volume", "entry_id", "name_rank")


# --- scalar functions


@register("fn_fold", f"{sql.BASE}SELECT volume, entry_id, low AS folded, name <> low AS has_upper FROM e UNION ALL {_values([('X:', 1, 'éİ\u212aȺß', True), ('X:', 2, 'straße', False)], 'volume, entry_id, folded, has_upper')}")
def _fold(spark, sf_dir):
    odd = spark.createDataFrame([("X:", 1, "Éİ\u212aȺß"), ("X:", 2, "straße")], "volume string, entry_id long, name string")
    rows = tables.entries(spark, sf_dir).select("volume", "entry_id", "name").unionByName(odd)
    return rows.select("volume", "entry_id", fold.fold(F.col("name")).alias("folded"), fold.has_upper(F.col("name")).alias("has_upper"))


_SPELLINGS = ["re\u0301sume\u0301.txt", "résumé.TXT", "\u212aelvin.txt", "kelvin.txt", "a\u037eb", "a;b", "plain", "I\u0307stanbul"]


@register("fn_nfc", "SELECT id, nfc_normalize(name) AS nfc FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_SPELLINGS)) + ") t(id, name) UNION ALL SELECT 1000 + doc_id, nfc_normalize(lang || source || doc_id) FROM documents")
def _nfc(spark, sf_dir):
    odd = spark.createDataFrame(list(enumerate(_SPELLINGS)), "id long, name string")
    docs = tables.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.concat("lang", "source", F.col("doc_id").cast("string")).alias("name"))
    return odd.unionByName(docs).select("id", fold.nfc(F.col("name")).alias("nfc"))


_SPELLED = "CASE o_orderkey % 4 WHEN 0 THEN 'R\u00e9sum\u00e9_' WHEN 1 THEN 're\u0301sume\u0301_' WHEN 2 THEN '\u212aelvin_' ELSE 'kelvin resume_' END || o_orderkey"


@register("fn_needs_canonical", f"WITH n AS (SELECT o_orderkey, lower(nfc_normalize({_SPELLED})) AS low FROM orders) SELECT query, o_orderkey FROM n, (VALUES ('r\u00e9sum\u00e9'), ('re\u0301sume\u0301'), ('kelvin'), ('resume')) q(query) WHERE contains(replace(low, chr(8490), 'k'), nfc_normalize(query))")
def _canonical(spark, sf_dir):
    """Names of orders in several spellings: literals with other spellings find them all, plain ones what they say."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SPELLED).alias("name")).withColumn("folded", fold.fold(F.col("name")))
    rows = search.spell_entries(o).withColumns({"tombstone": F.lit(False), "is_excluded": F.lit(False)})
    parts = [search.filtered(Catalogue(rows, rows), compile_query(q)).select(F.lit(q).alias("query"), "o_orderkey") for q in ("r\u00e9sum\u00e9", "re\u0301sume\u0301", "kelvin", "resume")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("fn_ext", f"{sql.BASE}SELECT volume, entry_id, CASE WHEN NOT is_dir AND contains(low, '.') THEN split_part(low, '.', -1) END AS ext FROM e")
def _ext(spark, sf_dir):
    return tables.catalogue(spark, sf_dir).entries.select("volume", "entry_id", scalars.extension(F.col("folded"), F.col("is_dir")).alias("ext"))


@register("fn_record", f"{sql.BASE}SELECT volume, frn, frn & 281474976710655 AS record, frn >> 48 AS seq, volume_ord * 4294967296 + entry_id AS entry_ref FROM e")
def _record(spark, sf_dir):
    frn = F.col("frn")
    return tables.catalogue(spark, sf_dir).entries.select("volume", "frn", scalars.record(frn).alias("record"), scalars.sequence(frn).alias("seq"), scalars.entry_ref(F.col("volume_ord"), F.col("entry_id")).alias("entry_ref"))


@register("fn_reason_bits", "SELECT event_id, (CASE event_type WHEN 'signup' THEN 256 WHEN 'click' THEN 8192 WHEN 'view' THEN 32768 WHEN 'purchase' THEN 2 ELSE 512 END) & 256 <> 0 AS created, event_type = 'error' AS deleted, event_type = 'click' AS renamed FROM events")
def _bits(spark, sf_dir):
    r = F.col("reason")
    return _events(spark, sf_dir).select(F.col("usn").alias("event_id"), scalars.has_reason(r, "FILE_CREATE").alias("created"), scalars.has_reason(r, "FILE_DELETE").alias("deleted"), scalars.has_reason(r, "RENAME_NEW_NAME").alias("renamed"))


_CUT = "c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '' END || substr(lower(c_mktsegment), 1, CAST(c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 5 = 0 THEN ':\\' WHEN c_custkey % 5 = 1 THEN ':' ELSE '' END"


@register("fn_label", f"WITH g AS (SELECT {_CUT} AS given FROM customer) SELECT *, CASE WHEN c_custkey % 3 = 1 THEN upper(substr(trim(given), 1, 1)) || ':' END AS label FROM g")
def _label(spark, sf_dir):
    given = tables.read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_CUT.partition(', ')[2]} AS given".replace("':\\'", "r':\\'"))
    return given.withColumn("label", scalars.volume_label(F.col("given")))


@register("fn_size_format", f"{sql.BASE}SELECT volume, entry_id, CASE WHEN is_dir THEN '' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{{:,.0f}} KB', size / 1024.0) WHEN size < 1073741824 THEN format('{{:,.1f}} MB', size / 1048576.0) ELSE format('{{:,.2f}} GB', size / 1073741824.0) END AS size_text FROM e")
def _size_format(spark, sf_dir):
    return tables.catalogue(spark, sf_dir).entries.select("volume", "entry_id", scalars.size_text(F.col("size"), F.col("is_dir")).alias("size_text"))


@register("fn_date_format", f"{sql.BASE}SELECT volume, entry_id, CASE WHEN mtime_secs <= 0 THEN '' ELSE strftime(make_timestamp(mtime_secs * 1000000), '%Y/%m/%d %H:%M') END AS date_text FROM e")
def _date_format(spark, sf_dir):
    return tables.catalogue(spark, sf_dir).entries.select("volume", "entry_id", scalars.date_text(F.col("mtime_secs")).alias("date_text"))


@register("fn_mtime_codec", "SELECT event_id, greatest(0, least(epoch_us(ts) // 1000000 - 1704067200 + (event_id % 3 - 1) * 3000000000, 4294967295)) AS secs FROM events")
def _codec(spark, sf_dir):
    secs = tables.seconds(F.col("ts")) - 1704067200 + (F.col("event_id") % 3 - 1) * 3000000000
    ticks = (secs + literals.EPOCH_SECONDS) * literals.TICKS + 5
    coded = scalars.seconds_of(ticks)
    return tables.read(spark, sf_dir, "events").select("event_id", scalars.seconds_of(scalars.ticks_of(coded)).alias("secs"))


@register("fn_civil", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 AS seconds, CAST(epoch(date_trunc('day', o_orderdate - INTERVAL 300 YEAR)) AS BIGINT) AS earlier FROM orders")
def _civil(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", scalars.midnight(day).alias("seconds"), scalars.midnight(F.add_months(day, -3600)).alias("earlier"))


#: Summer time from the last Sunday of March to that of October; a midnight is before the change.
_SUMMER = "d > make_date(year(d), 3, 31) - CAST(dayofweek(make_date(year(d), 3, 31)) AS INT) AND d <= make_date(year(d), 10, 31) - CAST(dayofweek(make_date(year(d), 10, 31)) AS INT)"


@register("fn_tz_midnight", f"WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS t FROM orders), o2 AS (SELECT o_orderkey, CAST(t AS DATE) AS d FROM o) SELECT o_orderkey, date_diff('day', DATE '1970-01-01', d) * 86400 - 32400 AS tokyo, date_diff('day', DATE '1970-01-01', d) * 86400 - CASE WHEN {_SUMMER} THEN 7200 ELSE 3600 END AS berlin FROM o2")
def _midnight(spark, sf_dir):
    day = F.add_months(F.col("o_orderdate").cast("date"), 120)
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", scalars.midnight(day, "Asia/Tokyo").alias("tokyo"), scalars.midnight(day, "Europe/Berlin").alias("berlin"))


@register("fn_highlight", f"{sql.BASE}SELECT volume, entry_id, CASE WHEN contains(low, 'order_1') THEN strpos(low, 'order_1') - 1 END AS name_start, CASE WHEN contains(lower(parent_path), 'asia') THEN strpos(lower(path), 'asia') - 1 END AS path_start FROM e WHERE NOT ex AND contains(low, 'order_1') AND contains(lower(path), 'asia')")
def _highlight(spark, sf_dir):
    c, plan = tables.catalogue(spark, sf_dir), compile_query("order_1 path:asia !zzz")
    marked = highlight.highlighted(tree.with_paths(search.filtered(c, plan), c.paths), plan)
    return marked.select("volume", "entry_id", F.get("name_marks", F.lit(0))["start"].alias("name_start"), F.get("path_marks", F.lit(0))["start"].alias("path_start"))


@register("fn_highlight_regex", f"{sql.BASE}SELECT volume, entry_id, CAST(0 AS BIGINT) AS start, CAST(strpos(name, '.') AS BIGINT) AS len FROM e WHERE NOT ex AND regexp_matches(low, '^order_[0-9]+\\.')")
def _highlight_regex(spark, sf_dir):
    c, plan = tables.catalogue(spark, sf_dir), compile_query("^order_[0-9]+\\.", Options(whole_regex="name"))
    marked = highlight.highlighted(tree.with_paths(search.filtered(c, plan), c.paths), plan)
    return marked.select("volume", "entry_id", F.explode("name_marks").alias("m")).select("volume", "entry_id", "m.start", "m.len")


# --- the journal and its batches

_REASON = {"signup": "FILE_CREATE", "click": "RENAME_NEW_NAME", "view": "BASIC_INFO_CHANGE", "purchase": "DATA_EXTEND", "error": "FILE_DELETE"}
_ROOT_FRN = (1 << 48) + tree.ROOT_RECORD


def _events(spark, sf_dir) -> DataFrame:
    """The events as change records; three neighbouring ones are of one object."""
    e = tables.read(spark, sf_dir, "events").withColumn("k", F.floor(F.col("event_id") / 3))
    reason = F.lit(0)
    for kind, name in _REASON.items():
        reason = F.when(F.col("event_type") == kind, scalars.REASONS[name]).otherwise(reason)
    name = F.concat(F.lit("f_"), F.col("k").cast("string"), F.lit("_"), (F.col("event_id") % 5).cast("string"), F.lit(".txt"))
    return e.select(F.col("event_id").alias("usn"), scalars.make_frn(1, F.col("k") + 1000).alias("frn"), F.lit(_ROOT_FRN).alias("parent_frn"), reason.cast("long").alias("reason"), F.lit(0).cast("long").alias("attributes"), name.alias("name"), "k")


def _before(spark, sf_dir) -> DataFrame:
    """Every second object stands before the batch."""
    k = _events(spark, sf_dir).select("k").distinct().where("k % 2 = 0")
    root = spark.createDataFrame([("J:", 0, 5, _ROOT_FRN, None, "J:", True, False, False, False, False, 0, 0)], apply.COLUMNS)
    no = F.lit(False)
    rows = k.select(F.lit("J:").alias("volume"), F.lit(0).alias("volume_ord"), (F.col("k") + 1000).alias("entry_id"), scalars.make_frn(1, F.col("k") + 1000).alias("frn"), F.lit(_ROOT_FRN).alias("parent_frn"), F.concat(F.lit("f_"), F.col("k").cast("string"), F.lit(".txt")).alias("name"), no.alias("is_dir"), no.alias("hidden"), no.alias("system"), no.alias("reparse"), no.alias("tombstone"), (F.col("k") * 10).alias("size"), F.lit(0).cast("long").alias("mtime_secs"))
    return root.unionByName(rows)


def _looked_up(spark, sf_dir) -> DataFrame:
    k = _events(spark, sf_dir).select("k").distinct().where("k % 3 = 0")
    return k.select(scalars.make_frn(1, F.col("k") + 1000).alias("frn"), (F.col("k") * 100).alias("size"), F.lit(10**9).cast("long").alias("mtime_secs"))


_applied: dict[tuple, apply.Applied] = {}


def _batch(spark, sf_dir) -> apply.Applied:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _applied:
        _applied[key] = apply.apply_batch(_before(spark, sf_dir), _events(spark, sf_dir).drop("k"), _looked_up(spark, sf_dir))
    return _applied[key]


@register("agg_usn_reduce", f"WITH {sql.JOURNAL} SELECT 281474976710656 + 1000 + k AS frn, bit_or(CASE t WHEN 'signup' THEN 256 WHEN 'click' THEN 8192 WHEN 'view' THEN 32768 WHEN 'purchase' THEN 2 ELSE 512 END) AS reasons, arg_max(name, usn) AS last_name, min(usn) AS first_usn FROM ev GROUP BY k")
def _reduce(spark, sf_dir):
    return apply.reduce_records(_events(spark, sf_dir)).select("frn", "reasons", F.col("last.name").alias("last_name"), "first_usn")


@register("st_apply_batch", f"WITH {sql.JOURNAL} SELECT entry_id, 281474976710656 + 1000 + k AS frn, name, tombstone, size, mtime_secs FROM done")
def _apply(spark, sf_dir):
    return _batch(spark, sf_dir).entries.where(~F.col("is_dir")).select("entry_id", "frn", "name", "tombstone", "size", "mtime_secs")


_PARTS = {
    "st_create": ("not tombstone and entry_id > {last} and not was", "NOT tombstone AND entry_id > (SELECT max(entry_id) FROM base) AND NOT was"),
    "st_delete": ("tombstone and action = 'delete'", "tombstone AND action = 'delete'"),
    "st_rename_file": ("was and action = 'upsert'", "was AND action = 'upsert'"),
    "st_stat": ("action = 'stat'", "action = 'stat'"),
}


def _part_query(condition: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _before(spark, sf_dir)
        last = before.agg(F.max("entry_id")).first()[0]
        what = apply.decide(before, _events(spark, sf_dir).drop("k"), _looked_up(spark, sf_dir), spark.createDataFrame([], apply.LINKS)).select("frn", "action", (F.col("n_links") > 0).alias("was"))
        return _batch(spark, sf_dir).entries.join(what, "frn").where(condition.format(last=last)).select("entry_id", "name", "size", "mtime_secs")

    return run


for _name, (_spark_part, _sql_part) in _PARTS.items():
    register(_name, f"WITH {sql.JOURNAL} SELECT entry_id, name, size, mtime_secs FROM done WHERE {_sql_part}")(_part_query(_spark_part))


@register("agg_batch_stats", f"WITH {sql.JOURNAL} SELECT count(*) FILTER (WHERE action = 'upsert') AS created_or_renamed, count(*) FILTER (WHERE action = 'delete' AND was) AS deleted, count(*) FILTER (WHERE action = 'stat' AND got IS NOT NULL) AS stat_updated, count(*) FILTER (WHERE action = 'ignore' OR action = 'delete' AND NOT was) AS ignored, count(*) FILTER (WHERE action IN ('upsert', 'stat') AND got IS NULL) AS stat_failures FROM act")
def _batch_stats(spark, sf_dir):
    found = _batch(spark, sf_dir).stats
    columns = ["created_or_renamed", "deleted", "stat_updated", "ignored", "stat_failures"]
    return spark.createDataFrame([tuple(found[c] for c in columns)], ", ".join(f"{c} long" for c in columns))


@register("join_stat_left", f"WITH {sql.JOURNAL} SELECT 281474976710656 + 1000 + k AS frn, coalesce(got, old_size, 0) AS size FROM act")
def _stat_left(spark, sf_dir):
    rows = apply.decide(_before(spark, sf_dir), _events(spark, sf_dir).drop("k"), _looked_up(spark, sf_dir), spark.createDataFrame([], apply.LINKS))
    return rows.select("frn", F.coalesce("fetched.size", "carried.size", F.lit(0)).alias("size"))


@register("st_flags", f"{sql.BASE}, n AS (SELECT *, record BETWEEN 2000 AND 2999 AND record % 3 = 0 OR split_part(path, chr(92), 3) IN (SELECT name FROM e WHERE record BETWEEN 2000 AND 2999 AND record % 3 = 0) OR record > 1000000000 AND record % 5 = 0 AS gone FROM e WHERE volume = 'C:') SELECT entry_id, name FROM n WHERE NOT ex AND NOT gone AND contains(low, '1')")
def _flags(spark, sf_dir):
    """Every third nation and every fifth order is hidden by records without looked-up sizes; searches see it at once."""
    engine = Engine(spark)
    rows = tables.entries(spark, sf_dir, ("C:",))
    engine.attach({"C:": rows})
    engine.search("1")
    hide = rows.where("entry_id between 2000 and 2999 and entry_id % 3 = 0 or entry_id > 1000000000 and entry_id % 5 = 0")
    attributes = F.when(F.col("is_dir"), scalars.ATTRIBUTES["DIRECTORY"]).otherwise(0) + scalars.ATTRIBUTES["HIDDEN"]
    records = hide.select(F.col("entry_id").alias("usn"), "frn", "parent_frn", F.lit(scalars.REASONS["BASIC_INFO_CHANGE"]).cast("long").alias("reason"), attributes.cast("long").alias("attributes"), "name")
    engine.apply("C:", records)
    return engine.search("1").rows.select("entry_id", "name")


@register("st_rename_dir", f"{sql.BASE}SELECT entry_id, CASE WHEN record = 2003 THEN 'C:' || chr(92) || 'MOVED' WHEN split_part(path, chr(92), 3) = 'NATION_3' THEN 'C:' || chr(92) || 'MOVED' || substr(path, strlen(split_part(path, chr(92), 2)) + 13) ELSE path END AS path FROM e WHERE volume = 'C:'")
def _rename_dir(spark, sf_dir):
    """One directory moves to the root; everything below follows without records of its own."""
    rows = tables.entries(spark, sf_dir, ("C:",)).select(*names())
    record = spark.createDataFrame([(1, (1 << 48) + 2003, _ROOT_FRN, scalars.REASONS["RENAME_NEW_NAME"], scalars.ATTRIBUTES["DIRECTORY"], "MOVED")], "usn long, frn long, parent_frn long, reason long, attributes long, name string")
    after = StoredCatalogue.build(rows).changed(apply.apply_batch(rows, record, loops=False).changes).catalogue
    return tree.with_paths(after.entries, after.paths).select("entry_id", "path")


@register("st_hardlink", f"WITH {sql.LINKS}, even AS (SELECT p, bool_or(o % 2 = 0) AS any_even FROM links GROUP BY p) SELECT entry_id, p % 10 = 0 AND o % 2 <> 0 AS tombstone, CASE WHEN p % 10 = 0 AND o % 2 = 0 THEN 7 ELSE size END AS size FROM links JOIN even USING (p)")
def _hardlink(spark, sf_dir):
    """Every tenth object's complete link set is looked up anew: links in odd orders are gone."""
    rows = tables.volume_f(spark, sf_dir).select(*names())
    links = rows.where("not is_dir").withColumn("p", scalars.record(F.col("frn")) - 5_000_000_000).where("p % 10 = 0")
    records = links.groupBy("frn", "p").agg(F.first("parent_frn").alias("parent_frn"), F.first("name").alias("name")).select(F.col("p").alias("usn"), "frn", "parent_frn", F.lit(scalars.REASONS["HARD_LINK_CHANGE"]).cast("long").alias("reason"), F.lit(0).cast("long").alias("attributes"), "name")
    even = F.col("parent_frn") % 2 == 0
    gone = links.groupBy("frn").agg(F.bool_or(even).alias("any_even")).where("not any_even").select("frn", F.lit(None).cast("long").alias("parent_frn"), F.lit(None).cast("string").alias("name"), F.lit("gone").alias("state"))
    found = links.where(even).select("frn", "parent_frn", "name", F.lit("present").alias("state")).unionByName(gone)
    stats = links.select("frn", F.lit(7).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_secs")).distinct()
    return apply.apply_batch(rows, records, stats, found).entries.where("not is_dir").select("entry_id", "tombstone", "size")


@register("st_reject", f"WITH {sql.JOURNAL} SELECT k, name FROM (SELECT arg_max(name, usn) AS name, k FROM ev GROUP BY k) WHERE k % 5 <> 0")
def _reject(spark, sf_dir):
    """All objects are new and every fifth has no parent: those are left out."""
    records = _events(spark, sf_dir).withColumn("reason", F.lit(scalars.REASONS["FILE_CREATE"]).cast("long")).withColumn("parent_frn", F.when(F.col("k") % 5 == 0, F.lit(12345).cast("long")).otherwise(F.col("parent_frn")))
    done = apply.apply_batch(_before(spark, sf_dir).where("is_dir"), records.drop("k"))
    return done.entries.where("not is_dir").select((scalars.record(F.col("frn")) - 1000).alias("k"), "name")


@register("st_compact", f"WITH {sql.JOURNAL} SELECT row_number() OVER (ORDER BY entry_id) AS entry_id, name FROM done WHERE NOT tombstone")
def _compact(spark, sf_dir):
    return apply.compact(_batch(spark, sf_dir).entries).where("not is_dir").select("entry_id", "name")


@register("st_compact_store", f"WITH {sql.JOURNAL.replace('ORDER BY first_usn', 'ORDER BY k % 2, first_usn')}, n AS (SELECT count(*) + 1 AS n_rows FROM done WHERE NOT tombstone) SELECT entry_id, name, size, n_rows, 3 AS version FROM done, n WHERE NOT tombstone")
def _compact_store(spark, sf_dir):
    """The journal in two batches of two writers into a store whose buckets shed their dead rows as they are rewritten; ids stay."""
    store = SnapshotStore(spark, temporary_path(spark, "store"), dead_share=0.0, least_rows=0)
    store.save(_before(spark, sf_dir), 7, 0)
    drop_at_end(spark, store.path)
    records, half = _events(spark, sf_dir), F.col("k") % 2 == 0
    for n, part in enumerate((half, ~half)):
        meta = apply.apply_to_store(store, records.where(part).drop("k"), _looked_up(spark, sf_dir), None, 0, writer=f"w{n}")
    rows = store.load(meta, sound=False).where("not is_dir").select("entry_id", "name", "size", "tombstone")
    return rows.select("entry_id", "name", "size", F.lit(meta.n_rows).cast("long").alias("n_rows"), F.lit(meta.version).alias("version"))


def _buffers(spark, sf_dir, n: int = 1, torn: bool = False) -> DataFrame:
    """Events as binary buffers of n records at most; torn ones have a tail that is no record behind every fourth."""
    rows = _events(spark, sf_dir).drop("k")

    def pack(batches):
        for batch in batches:
            found = list(journal.packed(zip(*(c.to_pylist() for c in batch.columns), strict=True), n, torn))
            ids, payloads = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], names=["buffer_id", "payload"])

    return rows.mapInArrow(pack, "buffer_id long, payload binary")


@register("src_usn_parse", "SELECT event_id AS usn, 'f_' || (event_id // 3) || '_' || (event_id % 5) || '.txt' AS name, event_id % 4 = 3 AS truncated FROM events")
def _parse(spark, sf_dir):
    """Events as binary buffers of one record, every fourth with a torn tail."""
    return journal.records(_buffers(spark, sf_dir, torn=True)).select("usn", "name", "truncated")


@register("src_usn_open", "SELECT event_id AS usn, 'f_' || (event_id // 3) || '_' || (event_id % 5) || '.txt' AS name FROM events WHERE event_id >= (SELECT (max(event_id) + 1) // 2 FROM events)")
def _open(spark, sf_dir):
    """What follows the cursor of a store that stands at the middle of the journal."""
    store = SnapshotStore(spark, temporary_path(spark, "store"))
    end = tables.read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    meta = store.save(_before(spark, sf_dir), 7, end // 2)
    drop_at_end(spark, store.path)
    opened = tail.open_at(meta, decisions.JournalView(7, 0, end))
    return journal.records(_buffers(spark, sf_dir, 256)).where(F.col("usn") >= opened.cursor).select("usn", "name")


@register("src_usn_tail", f"WITH {sql.JOURNAL} SELECT entry_id, name, tombstone, size FROM done")
def _follow(spark, sf_dir):
    """The binary journal through a stream; its second start finds nothing new and changes nothing."""
    at = temporary_path(spark, "tail")
    store = SnapshotStore(spark, f"{at}/store", dead_share=None)
    store.save(_before(spark, sf_dir), 7, 0)
    _buffers(spark, sf_dir, 256).withColumn("condition", F.lit(None).cast("string")).write.parquet(f"{at}/in")
    for _ in range(2):
        reads = spark.readStream.schema(tail.READS).parquet(f"{at}/in")
        tail.follow(reads, store, f"{at}/checkpoint", decisions.JournalView(7, 0), _looked_up(spark, sf_dir)).awaitTermination()
    drop_at_end(spark, at)
    return store.load(sound=False).where("not is_dir").select("entry_id", "name", "tombstone", "size")


@register("src_usn_source", f"WITH {sql.JOURNAL} SELECT entry_id, name, tombstone, size, (SELECT max(event_id) + 1 FROM events) AS next_usn FROM done")
def _source(spark, sf_dir):
    """The journal as files through a source of its own, from the store's cursor; a second start finds nothing new."""
    at = drop_at_end(spark, temporary_path(spark, "source"))
    store = SnapshotStore(spark, f"{at}/store", dead_share=None)
    store.save(_before(spark, sf_dir), 7, 0)

    def put(batches):
        for batch in batches:
            for first, after, payload in zip(batch["buffer_id"], batch["after"], batch["payload"], strict=True):
                journal_source.write_buffer(f"{at}/journal", first.as_py(), after.as_py(), payload.as_py())
            yield batch.select(["buffer_id"])

    # each buffer goes up to the next one, the last one to the journal's end
    written = _buffers(spark, sf_dir, 256)
    end = tables.read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    cursors = journal.records(written).groupBy("buffer_id").agg(F.max("next_usn").alias("after"))
    written.join(cursors, "buffer_id").mapInArrow(put, "buffer_id long").write.format("noop").mode("overwrite").save()
    journal_source.write_status(f"{at}/journal", 7, 0, end)
    for _ in range(2):
        tail.ended(tail.follow_journal(store, f"{at}/journal", f"{at}/checkpoint", _looked_up(spark, sf_dir)))
    return store.load(sound=False).where("not is_dir").select("entry_id", "name", "tombstone", "size", F.lit(store.latest().next_usn).cast("long").alias("next_usn"))


@register("src_metadata", f"WITH {sql.JOURNAL} SELECT 281474976710656 + 1000 + k AS frn, CASE WHEN k % 3 = 0 THEN 'present' ELSE 'failed' END AS stat_state, CASE k % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'gone' ELSE 'failed' END AS link_state FROM red")
def _metadata(spark, sf_dir):
    """Sizes known for every third object; link sets that are present, gone, failed, or were not looked up."""
    records = _events(spark, sf_dir)
    state = F.element_at(F.array(F.lit("present"), F.lit("gone"), F.lit("failed")), (F.col("k") % 4 + 1).cast("int"))
    links = records.where("k % 4 < 3").groupBy("frn", "k").agg(F.max("name").alias("name")).select("frn", F.lit(_ROOT_FRN).alias("parent_frn"), "name", state.alias("state"))
    return apply.decide(_before(spark, sf_dir), records.drop("k"), _looked_up(spark, sf_dir), links).select("frn", "stat_state", "link_state")


_LATE = sql.JOURNAL.replace("k % 3 = 0 THEN k * 100", "k % 3 < 2 THEN k * 100").replace("ORDER BY first_usn", "ORDER BY k % 2, first_usn")


@register("src_metadata_retry", f"WITH {_LATE}, w AS (SELECT count(*) AS n_waiting FROM act WHERE action IN ('upsert', 'stat') AND got IS NULL) SELECT entry_id, name, tombstone, size, mtime_secs, n_waiting FROM done, w")
def _metadata_retry(spark, sf_dir):
    """Look-ups that failed in a first batch and are there before a second one, which has other objects: their sizes come with it."""
    at = drop_at_end(spark, temporary_path(spark, "retry"))
    store, lookups = SnapshotStore(spark, f"{at}/store", dead_share=None), MetadataTables(spark, f"{at}/lookups")
    store.save(_before(spark, sf_dir), 7, 0)
    records = _events(spark, sf_dir)
    facts = records.select("k", "frn").distinct().select("k", "frn", (F.col("k") * 100).alias("size"), F.lit(10**9).cast("long").alias("mtime_secs"))
    for n in range(2):
        lookups.put(n, facts.where(F.col("k") % 3 == n))
        meta = apply.apply_to_store(store, records.where(F.col("k") % 2 == n).drop("k"), None, None, n, lookups=lookups)
    waiting = store.waiting(meta).select("frn").distinct().count()
    rows = store.load(meta, sound=False).where("not is_dir")
    return rows.select("entry_id", "name", "tombstone", "size", "mtime_secs", F.lit(waiting).cast("long").alias("n_waiting"))


@register("st_restore_decide", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'scan: first run' WHEN event_id % 7 = 1 THEN 'scan: snapshot unusable' WHEN event_id % 7 = 2 THEN 'scan: journal query failed' WHEN event_id % 7 = 3 OR event_id < 500 THEN 'scan: checkpoint stale' ELSE 'restore' END AS decision FROM events")
def _restore(spark, sf_dir):
    """A checkpoint at each event, some of them missing, of another format or journal, or before the journal's first record."""
    e = F.col("event_id")
    form = F.when(e % 7 == 1, "other").otherwise(decisions.FORMAT)
    checkpoint = F.when(e % 7 != 0, F.struct(form.alias("format"), F.when(e % 7 == 3, 8).otherwise(7).alias("journal_id"), e.alias("next_usn")))
    view = F.when(e % 7 != 2, F.struct(F.lit(7).alias("journal_id"), F.lit(500).alias("first_usn")))
    rows = tables.read(spark, sf_dir, "events").select("event_id", checkpoint.alias("checkpoint"), view.alias("view"))
    return rows.select("event_id", decisions.restore_decisions(F.col("checkpoint"), F.col("view")).alias("decision"))


@register("st_tail_decide", "SELECT event_id AS buffer_id, CASE WHEN event_id % 11 = 0 THEN 'fail' WHEN event_id % 9 = 0 OR event_id % 4 = 3 THEN 'rescan' ELSE 'apply' END AS decision FROM events")
def _tail(spark, sf_dir):
    """Reads of one event each: every eleventh failed, every ninth says that the journal is gone, every fourth is torn."""
    b = F.col("buffer_id")
    gone = F.element_at(F.array(*[F.lit(c) for c in tail.GONE]), (F.floor(b / 9) % len(tail.GONE) + 1).cast("int"))
    reads = _buffers(spark, sf_dir, torn=True).withColumn("condition", F.when(b % 11 == 0, "read failed").when(b % 9 == 0, gone))
    return tail.judged(reads).select("buffer_id", "decision")


# --- decoded file records


def _records(spark, sf_dir) -> DataFrame:
    """Orders as file records: every fifth has its names in an extension, every seventh is not in use."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    long_name = F.concat(F.lit("Order_"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    short_name = F.concat(F.lit("ORDER~"), F.col("o_orderkey").cast("string"))
    parent = F.lit(1 << 48).bitwiseOR(F.col("o_custkey"))

    def name(space: int, text):
        return F.struct(F.lit(space).alias("namespace"), parent.alias("parent_frn"), text.alias("name"))

    both = F.array(name(1, long_name), name(2, short_name))
    none = F.array().cast("array<struct<namespace:int,parent_frn:long,name:string>>")
    away = F.col("o_orderkey") % 5 == 0
    record = F.col("o_orderkey") * 2 + 100
    size = F.round(F.col("o_totalprice") * 100).cast("long")
    streams = F.array(F.struct(F.lit("zone").alias("name"), F.lit(7).cast("long").alias("size")), F.struct(F.lit("").alias("name"), size.alias("size")))
    common = [F.lit(3).alias("sequence"), (F.col("o_orderkey") % 7 != 0).alias("in_use"), (F.col("o_orderstatus") == "P").alias("is_dir")]
    base = o.select(record.alias("record"), *common, F.lit(0).cast("long").alias("base"), F.when(away, none).otherwise(both).alias("names"), streams.alias("streams"), F.lit(0).cast("long").alias("mtime_secs"), F.lit(0).cast("long").alias("attributes"))
    more = o.where(away).select((record + 1).alias("record"), *common, record.alias("base"), both.alias("names"), F.array().cast("array<struct<name:string,size:long>>").alias("streams"), F.lit(0).cast("long").alias("mtime_secs"), F.lit(0).cast("long").alias("attributes"))
    own = spark.createDataFrame([(0, 1, True, False, 0, [(3, 5, "$own")], [], 0, 0)], records.RECORDS)
    return base.unionByName(more).unionByName(own)


@register("src_record_parse", "SELECT o_orderkey * 2 + 100 AS record, 'Order_' || o_orderkey || '.txt' AS name, o_orderstatus = 'P' AS is_dir FROM orders WHERE o_orderkey % 7 <> 0")
def _record_parse(spark, sf_dir):
    return records.link_rows(_records(spark, sf_dir)).select("record", "name", "is_dir")


@register("src_attr_extract", "SELECT o_orderkey * 2 + 100 AS record, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS size FROM orders")
def _attr_extract(spark, sf_dir):
    return _records(spark, sf_dir).where("base = 0 and record >= 100").select("record", records.content_size().alias("size"))


@register("src_searchable_names", "SELECT o_orderkey * 2 + 100 AS record, 281474976710656 + o_custkey AS parent_frn, 844424930131968 + o_orderkey * 2 + 100 AS frn FROM orders WHERE o_orderkey % 7 <> 0")
def _searchable(spark, sf_dir):
    return records.link_rows(_records(spark, sf_dir)).select("record", "parent_frn", "frn")


@register("src_deferred_join", "SELECT o_orderkey * 2 + 100 AS record, 2 AS n_names FROM orders WHERE o_orderkey % 7 <> 0")
def _deferred(spark, sf_dir):
    return records.deferred_names(_records(spark, sf_dir)).where("record >= 100").select("record", F.size("names").alias("n_names"))


# --- names outside Unicode


@register("fn_wtf8_encode", "SELECT doc_id, hex(encode(lang || '_é𝄞_' || source)) AS wtf8 FROM documents UNION ALL SELECT -1, '41EDA08042' UNION ALL SELECT -2, 'F09F8E89'")
def _wtf8_encode(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat("lang", F.lit("_é𝄞_"), "source"), "UTF-16LE").alias("u"))
    odd = spark.createDataFrame([(-1, bytearray(b"A\x00\x00\xd8B\x00")), (-2, bytearray("🎉".encode("utf-16-le")))], "doc_id long, u binary")
    return d.unionByName(odd).select("doc_id", F.hex(wtf8.encode("u")).alias("wtf8"))


@register("fn_wtf8_decode", "SELECT doc_id, length(lang || source) * 2 + 8 AS n_bytes, true AS same FROM documents")
def _wtf8_decode(spark, sf_dir):
    """Round trips, with a lone surrogate in every name."""
    u = F.concat(F.encode(F.concat("lang", "source"), "UTF-16LE"), F.unhex(F.lit("00D841003CD889DF")))
    d = tables.read(spark, sf_dir, "documents").select("doc_id", u.alias("u"))
    back = d.withColumn("b", wtf8.decode(wtf8.encode("u")))
    return back.select("doc_id", F.length("b").alias("n_bytes"), (F.col("b") == F.col("u")).alias("same"))


@register("flt_regex_wtf8", "WITH n AS (SELECT doc_id, lang, source FROM documents) SELECT '^en.src1' AS pattern, doc_id FROM n WHERE doc_id % 3 < 2 AND lang = 'en' AND starts_with(source, 'src1') UNION ALL SELECT '^EN.*[02468]$', doc_id FROM n WHERE lang = 'en' AND regexp_matches(source, '[02468]$')")
def _regex_wtf8(spark, sf_dir):
    """Patterns over names of which a third holds a lone surrogate, which is one character to a pattern."""
    d = tables.read(spark, sf_dir, "documents")
    middle = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("00D8"))).when(F.col("doc_id") % 3 == 1, F.encode(F.lit("é"), "UTF-16LE")).otherwise(F.unhex(F.lit("")))
    rows = d.select("doc_id", F.concat(F.encode("lang", "UTF-16LE"), middle, F.encode("source", "UTF-16LE")).alias("u")).select("doc_id", wtf8.encode("u").alias("b"))
    parts = [rows.where(wtf8.matches(F.col("b"), regexes.to_java(p, i))).select(F.lit(p).alias("pattern"), "doc_id") for p, i in (("^en.src1", False), ("^EN.*[02468]$", True))]
    return parts[0].unionByName(parts[1])


# --- snapshots, the stream, the driver's own figures


@register("sink_snapshot_save", f"{sql.BASE}SELECT volume, entry_id, frn, parent_frn, name, size, mtime_secs FROM e")
def _snapshot(spark, sf_dir):
    """Saved, committed, loaded again with all checks."""
    store = SnapshotStore(spark, temporary_path(spark, "store"))
    store.save(tables.entries(spark, sf_dir), 1, 1)
    drop_at_end(spark, store.path)
    return store.load().select("volume", "entry_id", "frn", "parent_frn", "name", "size", "mtime_secs")


@register("src_snapshot_load", f"{sql.BASE}SELECT count(*) AS n_rows, 2 AS version FROM e WHERE volume = 'C:'")
def _snapshot_load(spark, sf_dir):
    """The later of two committed versions."""
    store = SnapshotStore(spark, temporary_path(spark, "store"))
    store.save(tables.entries(spark, sf_dir, ("D:",)), 1, 1)
    meta = store.save(tables.entries(spark, sf_dir, ("C:",)), 1, 2)
    drop_at_end(spark, store.path)
    return store.load(meta).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("version", F.lit(meta.version))


@register("st_checkpoint", f"WITH {sql.JOURNAL} SELECT entry_id, name, tombstone, size FROM done")
def _stream(spark, sf_dir):
    """The journal through a stream; its second start finds nothing new and changes nothing."""
    at = temporary_path(spark, "stream")
    store = SnapshotStore(spark, f"{at}/store", dead_share=None)
    store.save(_before(spark, sf_dir), 1, 0)
    batch = _events(spark, sf_dir).drop("k")
    batch.write.parquet(f"{at}/in")
    for _ in range(2):
        stream = spark.readStream.schema(batch.schema).parquet(f"{at}/in")
        apply.start(stream, store, f"{at}/checkpoint", _looked_up(spark, sf_dir)).awaitTermination()
    drop_at_end(spark, at)
    return store.load(sound=False).where("not is_dir").select("entry_id", "name", "tombstone", "size")


def _debounce(spark, sf_dir):
    """All events as one sequence, 70 ms from one id to the next."""
    events = tables.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 70).alias("ms"))
    return debounced(events, "ms", ["event_id"], 200).select((F.col("pos") + 1).alias("i"), "passes")


BY_TEST["st_debounce"] = _debounce
