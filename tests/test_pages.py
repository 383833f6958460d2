"""Stored orders: parts in either direction, pages that seek, changes that merge."""

from __future__ import annotations

import os
import random

import pytest

from arbordex.operators import search
from arbordex.operators.pages import StoredOrders
from arbordex.operators.ranges import Order, Ranges
from arbordex.operators.search import Catalogue
from arbordex.plans.compiler import Options

SCHEMA = "volume_ord int, entry_id long, key string, is_excluded boolean, other long"
#: Keys that few rows have, and one that a third of all rows have, in several volumes.
RNG = random.Random(4)


def some(n, first=0):
    return [(RNG.choice((0, 0, 2, 3)), first + i, "hot" if RNG.random() < 0.35 else f"k{RNG.randrange(40):02}" if RNG.random() < 0.8 else f"z{i}é", RNG.random() < 0.2, i) for i in range(n)]


def ordered(rows, desc):
    if not desc:
        return sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    return sorted(sorted(rows, key=lambda r: (r[0], -r[1])), key=lambda r: r[2], reverse=True)


def check(ranges, rows):
    """Counts, bounds, sizes, and every page of both directions."""
    assert ranges.n == len(rows) and sum(p.visible for p in ranges.parts) == sum(not r[3] for r in rows)
    lows = [p.low for p in ranges.parts]
    assert lows == sorted(lows) and lows[0] == (0,)
    counts = {p.number: p.n for p in ranges.parts}
    held = {}
    for r in ranges.rows.collect():
        held.setdefault(r["__part"], []).append(tuple(r)[:5])
    for desc in (False, True):
        want, got = ordered(rows, desc), []
        for p in ranges.turned(desc):
            got += ordered(held.get(p.number, []), desc)
        assert got == want
    for offset, n in ((0, 7), (len(rows) // 2, 5), (max(0, len(rows) - 3), 10), (len(rows) + 5, 3)):
        parts, before = ranges.slice(counts, offset, n, True)
        assert sum(counts[p.number] for p in parts) <= 3 * ranges.order.part_rows + n
        got = [r for p in parts for r in ordered(held[p.number], True)]
        assert got[offset - before :][:n] == ordered(rows, True)[offset : offset + n]


@pytest.mark.parametrize(("n", "part_rows"), [(0, 10), (9, 10), (300, 16), (300, 50), (300, 1)])
def test_build_and_merge(spark, n, part_rows):
    rows = some(n)
    ranges = Ranges.build(spark.createDataFrame(rows, SCHEMA), Order("key", part_rows=part_rows))
    check(ranges, rows)
    assert part_rows == 1 or all(p.n <= 2 * part_rows for p in ranges.parts)
    # a batch changes, removes and adds rows; a new volume has the hot key; a rare key becomes frequent
    gone = RNG.sample(rows, min(len(rows), 12))
    new = [(r[0], r[1], "k07", not r[3], -1) for r in gone[::2]] + some(10, 1000) + [(1, 2000 + i, "hot", False, 0) for i in range(4)] + [(2, 3000 + i, "k03", False, 0) for i in range(3 * part_rows)]
    after = ranges.merge(spark.createDataFrame(gone, SCHEMA), spark.createDataFrame(new, SCHEMA))
    check(after, [r for r in rows if r not in gone] + new)
    check(ranges, rows)  # the version before is as it was
    again = after.merge(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([], SCHEMA))
    check(again, [r for r in rows if r not in gone])


def test_a_small_batch_rewrites_few_parts(spark):
    rows = [(0, i, f"k{i % 200:03}", False, i) for i in range(2000)]
    ranges = Ranges.build(spark.createDataFrame(rows, SCHEMA), Order("key", part_rows=50))
    one = rows[77]
    after = ranges.merge(spark.createDataFrame([one], SCHEMA), spark.createDataFrame([(0, 77, "k150", False, 0)], SCHEMA))
    kept = {p.folder for p in ranges.parts} & {p.folder for p in after.parts}
    assert len(ranges.parts) > 30 and len(kept) == len(ranges.parts) - 2
    assert ranges.merge(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)) is ranges


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    from arbordex.sources import tables

    return StoredOrders(tables.catalogue(spark, sf_dir), part_rows=200)


QUERIES = [("", Options()), ("", Options(include_hidden_system=True)), ("order_1", Options(sort="size", desc=True)), ("e", Options(sort="mtime", desc=True)), ("file:", Options(sort="mtime")), ("path:asia 7", Options(sort="size")), ("folder:", Options(sort="size", desc=True)), ("nothing like it", Options()), ("x | ", Options(desc=True))]


@pytest.mark.parametrize(("text", "options"), QUERIES)
def test_pages_are_slices_of_the_sorted_result(orders, text, options):
    whole = [(r["volume_ord"], r["entry_id"]) for r in search.search(orders.catalogue, text, options).collect()]
    hits = orders.hits(text, options)
    assert hits.n == len(whole)
    for offset in (0, 1, len(whole) // 2, max(0, len(whole) - 5), len(whole) + 1):
        got = hits.numbered(offset, 64).orderBy("pos").collect()
        assert [(r["volume_ord"], r["entry_id"]) for r in got] == whole[offset : offset + 64]
        assert [r["pos"] for r in got] == list(range(offset, min(offset + 64, len(whole))))


def test_a_page_reads_the_files_of_few_parts(orders):
    """Deep in a result of all rows, a page's files are those of its parts, and counting reads none."""
    hits = orders.hits("", Options(sort="size", desc=True))
    assert len(hits.ranges.parts) > 10
    for offset in (0, hits.n // 2, hits.n - 64):
        parts, _ = hits.ranges.slice(hits.counts, offset, 64, True)
        files = {os.path.dirname(f) for f in hits.ranges.read(parts).inputFiles()}
        assert len(files) == len(parts) <= 3


def test_a_narrower_search_reads_the_parts_of_the_wider(orders):
    wide = orders.hits("order_12", Options())
    narrow = orders.hits("order_123", Options(), wide)
    assert narrow.n == search.count(orders.catalogue, "order_123") and set(narrow.counts) <= set(wide.counts)


def test_orders_after_a_change(spark, orders):
    c = orders.catalogue
    for sort in ("name", "size"):
        orders.ranges(sort)
    live = c.entries.where("not tombstone").drop("tombstone")
    gone = live.where("entry_id % 11 = 0")
    new = gone.where("entry_id % 2 = 0").withColumn("size", live["size"] * 3 + 1)
    entries = live.where("entry_id % 11 <> 0").unionByName(new).selectExpr("*", "false as tombstone")
    after = orders.changed(gone, new, Catalogue(entries, c.paths))
    for text, options in (("", Options()), ("1", Options(sort="size", desc=True)), ("e", Options(sort="mtime"))):
        whole = [(r["volume_ord"], r["entry_id"]) for r in search.search(after.catalogue, text, options).collect()]
        hits = after.hits(text, options)
        assert hits.n == len(whole)
        assert [(r["volume_ord"], r["entry_id"]) for r in hits.numbered(5, 300).orderBy("pos").collect()] == whole[5:305]
