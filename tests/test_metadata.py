"""Look-ups that fail and come later: what waits, what heals, and what the tables of look-ups read."""

from __future__ import annotations

import os
import random

import pytest
from helpers import entry, f, frame, root

from arbordex.errors import RescanRequired
from arbordex.functions.scalars import ATTRIBUTES, REASONS
from arbordex.sources.metadata import LINKS, STATS, MetadataTables
from arbordex.sources.snapshots import SnapshotStore
from arbordex.streaming import apply

RECORDS = "usn long, frn long, parent_frn long, reason long, attributes long, name string"


def rec(usn, k, reason, name, parent=10, attributes=0):
    return (usn, f(k), f(parent), REASONS[reason], attributes, name)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), RECORDS)


def sizes(spark, *pairs):
    return spark.createDataFrame([(f(k), size, 9) for k, size in pairs], STATS)


def links(spark, *rows):
    return spark.createDataFrame([(f(k), None if p is None else f(p), n, s) for k, p, n, s in rows], LINKS)


@pytest.fixture
def made(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4, keep=3)
    store.save(frame(spark, [root(), entry("d0", 10, 5, True), entry("d1", 11, 5, True), *[entry(f"n{k}", 50 + k, 10, size=k) for k in range(6)]]), 7, 0)
    return store, MetadataTables(spark, f"file://{tmp_path}/m", buckets=8)


def files(store):
    return {(r["frn"] & 0xFFFF, r["name"]): r["size"] for r in store.load().where("not tombstone and not is_dir").collect()}


def waits(store, writer=""):
    return sorted((r["frn"] & 0xFFFF, r["kind"], r["since"]) for r in store.waiting(store.latest(), writer).collect())


def test_tables_give_what_was_seen_last(spark, tmp_path):
    tables = MetadataTables(spark, f"file://{tmp_path}/m", buckets=8)
    keys = spark.createDataFrame([(f(k),) for k in (1, 2, 3, 1)] + [(None,)], "frn long")
    assert [t.count() for t in tables.look_up(keys)] == [0, 0]
    tables.put(0, sizes(spark, (1, 10), (2, 20), (9, 90)), links(spark, (1, 5, "a", "present"), (1, 6, "b", "present"), (2, None, None, "gone")))
    tables.put(1, sizes(spark, (1, 11)), links(spark, (1, 5, "c", "present")))
    tables.put(1, sizes(spark, (1, 11)), links(spark, (1, 5, "c", "present")))
    for now in (tables, tables.merged(f"file://{tmp_path}/n")):
        stats, found = now.look_up(keys)
        assert sorted(tuple(r) for r in stats.collect()) == [(f(1), 11, 9), (f(2), 20, 9)]
        assert sorted(tuple(r) for r in found.collect()) == [(f(1), f(5), "c", "present"), (f(2), None, None, "gone")]
    # only the buckets of the keys are read
    one, _ = tables.look_up(keys.where(f"frn = {f(1)}"))
    assert len({os.path.basename(os.path.dirname(p)) for p in one.inputFiles()}) == 1 and os.listdir(f"{tmp_path}/m/stats") != []


def test_sizes_come_later(spark, made):
    store, tables = made
    apply.apply_to_store(store, batch(spark, rec(1, 50, "DATA_EXTEND", "n0", attributes=ATTRIBUTES["HIDDEN"]), rec(2, 80, "FILE_CREATE", "new"), rec(3, 51, "DATA_EXTEND", "n1")), None, None, 0, lookups=tables)
    assert waits(store) == [(50, "stat", 0), (51, "stat", 0), (80, "stat", 0)] and files(store)[80, "new"] == 0
    # a batch of other objects: one size is there by now, another object goes
    tables.put(0, sizes(spark, (80, 800), (99, 1)))
    apply.apply_to_store(store, batch(spark, rec(4, 51, "FILE_DELETE", "n1")), None, None, 1, lookups=tables)
    assert files(store)[80, "new"] == 800 and waits(store) == [(50, "stat", 0)]
    # a record of the object itself takes the waiting one with it, also where it asks for no size
    apply.apply_to_store(store, batch(spark, rec(5, 50, "CLOSE", "n0")), None, None, 2, lookups=tables)
    assert waits(store) == [(50, "stat", 0)]
    before = store.latest()
    assert apply.heal(store, tables).n_rows == before.n_rows
    tables.put(1, sizes(spark, (50, 500)))
    after = apply.heal(store, tables)
    assert waits(store) == [] and files(store)[50, "n0"] == 500 and (after.next_usn, after.batches) == (before.next_usn, before.batches)
    assert apply.heal(store, tables) == after


def test_links_wait_without_a_rescan(spark, made):
    """A file whose link set is missing stays as it was, the others go on; its records come together when it is there."""
    store, tables = made
    apply.apply_to_store(store, batch(spark, rec(1, 50, "HARD_LINK_CHANGE", "n0"), rec(2, 51, "FILE_DELETE", "n1")), None, None, 0, lookups=tables)
    assert (51, "n1") not in files(store) and (50, "n0") in files(store) and waits(store) == [(50, "links", 0)]
    apply.apply_to_store(store, batch(spark, rec(3, 50, "RENAME_OLD_NAME", "n0"), rec(4, 50, "RENAME_NEW_NAME", "m0")), None, None, 1, lookups=tables)
    assert waits(store) == [(50, "links", 0)] * 3 and store.latest().next_usn == 5
    tables.put(0, sizes(spark, (50, 5)), links(spark, (50, 10, "m0", "present"), (50, 11, "two", "present")))
    apply.apply_to_store(store, batch(spark, rec(5, 52, "FILE_DELETE", "n2")), None, None, 2, lookups=tables)
    assert waits(store) == [] and {k for k in files(store) if k[0] in (50, 52)} == {(50, "m0"), (50, "two")}
    # an object that is gone by now
    apply.apply_to_store(store, batch(spark, rec(6, 53, "HARD_LINK_CHANGE", "n3")), None, None, 3, lookups=tables)
    tables.put(1, links=links(spark, (53, None, None, "gone")))
    apply.heal(store, tables)
    assert waits(store) == [] and (53, "n3") not in files(store)
    # patience ends; nothing of that batch is kept
    apply.apply_to_store(store, batch(spark, rec(7, 54, "HARD_LINK_CHANGE", "n4")), None, None, 4, lookups=tables, patience=2)
    meta = store.latest()
    with pytest.raises(RescanRequired):
        apply.apply_to_store(store, batch(spark, rec(8, 55, "FILE_DELETE", "n5")), None, None, 7, lookups=tables, patience=2)
    assert store.latest() == meta and (55, "n5") in files(store)
    # a directory's link change needs a new scan at once
    with pytest.raises(RescanRequired):
        apply.apply_to_store(store, batch(spark, rec(9, 11, "HARD_LINK_CHANGE", "d1", 5, ATTRIBUTES["DIRECTORY"])), None, None, 8, lookups=tables)


def test_each_writer_has_its_own_and_old_folders_go(spark, made, tmp_path):
    store, tables = made
    for n in range(4):
        apply.apply_to_store(store, batch(spark, rec(n, 50 + n % 2, "DATA_EXTEND", f"n{n % 2}")), None, None, n // 2, writer=f"w{n % 2}", lookups=tables)
    assert waits(store, "w0") == [(50, "stat", 0)] and waits(store, "w1") == [(51, "stat", 0)]
    tables.put(0, sizes(spark, (50, 500), (51, 510)))
    apply.heal(store, tables, "w0")
    assert waits(store, "w0") == [] and waits(store, "w1") == [(51, "stat", 0)]
    for n in range(3):
        apply.heal(store, tables, "w1")
        apply.apply_to_store(store, batch(spark, rec(10 + n, 52, "DATA_EXTEND", "n2")), sizes(spark, (52, n)), None, 5 + n, writer="w0")
    assert waits(store, "w1") == [] and files(store)[51, "n1"] == 510
    kept = {w for v in store._commits() for ws in store._meta(v).waiting.values() for w in ws}
    assert {f"w={v}/{t}" for v in (d[2:] for d in os.listdir(f"{tmp_path}/s") if d[:2] == "w=") for t in os.listdir(f"{tmp_path}/s/w={v}")} == kept
    # whole rows begin anew
    store.save(store.load(), 7, 20)
    assert store.latest().waiting == {}


def test_late_look_ups_end_where_early_ones_do(spark, tmp_path):
    """Random batches whose look-ups come late, or never in time, against the same with all known beforehand."""
    rng = random.Random(5)
    start = [root(), entry("d0", 10, 5, True), *[entry(f"n{k}", 50 + k, 10, size=k) for k in range(8)]]
    every = sizes(spark, *[(k, 100 + k) for k in range(40, 80)])
    shape = ["entry_id", "frn", "name", "size", "hidden"]
    late, early = (SnapshotStore(spark, f"file://{tmp_path}/{n}", buckets=2) for n in ("late", "early"))
    tables = MetadataTables(spark, f"file://{tmp_path}/m", buckets=4)
    for store in (late, early):
        store.save(frame(spark, start), 7, 0)
    for n in range(4):
        rows = [rec(10 * n + i, rng.randrange(48, 62), rng.choice(("FILE_CREATE", "FILE_DELETE", "DATA_EXTEND", "BASIC_INFO_CHANGE")), f"x{n}_{i}", attributes=rng.choice((0, ATTRIBUTES["HIDDEN"]))) for i in range(6)]
        apply.apply_to_store(late, batch(spark, *rows), None, None, n, lookups=tables)
        apply.apply_to_store(early, batch(spark, *rows), every, None, n)
        tables.put(n, every.where(f"frn % 7 = {n}"))
    tables.put(9, every)
    apply.heal(late, tables)
    got, want = (sorted(tuple(r) for r in s.load().where("not tombstone").select(*shape).collect()) for s in (late, early))
    assert got == want and waits(late) == []


def test_a_batch_reads_and_joins_nothing_twice(spark, made):
    """Where nothing waits and a batch's objects lie in all buckets, neither waiting records nor other buckets' directories are joined."""
    store, tables = made
    tables.put(0, sizes(spark, (50, 5)))
    spark.sparkContext.setJobGroup("retry", "")
    try:
        apply.apply_to_store(store, batch(spark, *[rec(k, 50 + k, "DATA_EXTEND", f"n{k}") for k in range(20)]), None, None, 0, lookups=tables)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("retry")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 100 jobs when both were
    assert len(jobs) < 85 and len(waits(store)) == 5
