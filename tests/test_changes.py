"""Change batches, snapshots and streams."""

from __future__ import annotations

import random

import pytest
from helpers import entry, f, frame, root

from arbordex.errors import SnapshotInvalid, TopologyError
from arbordex.functions.scalars import ATTRIBUTES, REASONS
from arbordex.operators import tree
from arbordex.operators.statistics import live
from arbordex.sources import journal
from arbordex.sources.snapshots import SnapshotStore
from arbordex.streaming import apply, decisions

RECORDS = "usn long, frn long, parent_frn long, reason long, attributes long, name string"
DIR = ATTRIBUTES["DIRECTORY"]


def rec(usn, frn, parent, reasons, name, attributes=0):
    mask = 0
    for r in reasons.split("|"):
        mask |= REASONS[r]
    return (usn, frn, parent, mask, attributes, name)


def base(spark):
    return frame(spark, [root(), entry("docs", 10, 5, True), entry("note.txt", 11, 10, size=100, mtime=9), entry("archive", 20, 5, True)])


def run(spark, rows, records, stats=(), links=()):
    return apply.apply_batch(rows, spark.createDataFrame(records, RECORDS), spark.createDataFrame(list(stats), apply.STATS), spark.createDataFrame(list(links), apply.LINKS))


def paths(entries):
    rows = live(entries)
    return sorted(r["path"] for r in tree.with_paths(rows, tree.close_directories(entries)).collect())


BASE_PATHS = ["C:", "C:\\archive", "C:\\docs", "C:\\docs\\note.txt"]


def test_rename_storm(spark):
    records = []
    for i, name in enumerate(("a.txt", "b.txt", "最終版.txt")):
        records += [rec(2 * i, f(11), f(10), "RENAME_OLD_NAME", "note.txt" if i == 0 else "x"), rec(2 * i + 1, f(11), f(10), "RENAME_NEW_NAME", name)]
    done = run(spark, base(spark), records)
    assert done.stats["created_or_renamed"] == 1 and not done.rescan_required
    row = live(done.entries).where("name = '最終版.txt'").first()
    assert (row["size"], row["mtime_secs"]) == (100, 9) and "C:\\docs\\最終版.txt" in paths(done.entries)
    assert live(done.entries).count() == 4


def test_directory_move(spark):
    done = run(spark, base(spark), [rec(1, f(10), f(5), "RENAME_OLD_NAME", "docs", DIR), rec(2, f(10), f(20), "RENAME_NEW_NAME", "docs", DIR)])
    assert "C:\\archive\\docs\\note.txt" in paths(done.entries)
    assert done.entries.where("name = 'docs'").first()["entry_id"] == 10


def test_create_and_delete(spark):
    made = run(spark, base(spark), [rec(1, f(30), f(10), "FILE_CREATE", "new.bin")], [(f(30), 123, 5)])
    assert live(made.entries).where("name = 'new.bin' and size = 123 and mtime_secs = 5").count() == 1
    gone = run(spark, made.entries, [rec(2, f(30), f(10), "FILE_DELETE", "new.bin")])
    assert paths(gone.entries) == BASE_PATHS and gone.stats["deleted"] == 1
    both = run(spark, base(spark), [rec(1, f(31), f(10), "FILE_CREATE", "x"), rec(2, f(31), f(10), "FILE_DELETE", "x")])
    assert paths(both.entries) == BASE_PATHS and both.stats["ignored"] == 1


def test_attributes_without_metadata(spark):
    hidden = run(spark, base(spark), [rec(1, f(11), f(10), "BASIC_INFO_CHANGE", "note.txt", ATTRIBUTES["HIDDEN"] | ATTRIBUTES["SYSTEM"])])
    row = live(hidden.entries).where("name = 'note.txt'").first()
    assert row["hidden"] and row["system"] and row["size"] == 100 and hidden.stats["stat_failures"] == 1
    shown = run(spark, hidden.entries, [rec(2, f(11), f(10), "BASIC_INFO_CHANGE", "note.txt")])
    assert not live(shown.entries).where("name = 'note.txt'").first()["hidden"]


def test_generations(spark):
    late = run(spark, base(spark), [rec(1, f(11, 0), f(10), "FILE_DELETE", "note.txt"), rec(2, f(12, 9), f(10), "DATA_EXTEND", "none")])
    assert paths(late.entries) == BASE_PATHS and late.stats["ignored"] == 2
    reused = run(spark, base(spark), [rec(1, f(11, 2), f(20), "FILE_CREATE", "second.txt")])
    assert paths(reused.entries) == ["C:", "C:\\archive", "C:\\archive\\second.txt", "C:\\docs"]
    stale = run(spark, reused.entries, [rec(2, f(11, 1), f(10), "RENAME_NEW_NAME", "old.txt")])
    assert paths(stale.entries) == paths(reused.entries)


def test_parents_made_in_the_batch(spark):
    done = run(spark, base(spark), [rec(1, f(41), f(40), "FILE_CREATE", "child.txt"), rec(2, f(40), f(5), "FILE_CREATE", "dir", DIR)])
    assert "C:\\dir\\child.txt" in paths(done.entries) and not done.rescan_required


def test_rejected_parents(spark):
    done = run(spark, base(spark), [rec(1, f(40), f(99), "FILE_CREATE", "d", DIR), rec(2, f(41), f(40), "FILE_CREATE", "under it"), rec(3, f(42), f(11), "FILE_CREATE", "under file"), rec(4, f(43), f(10), "FILE_CREATE", "good")])
    assert done.rescan_required and done.stats["index_rejections"] == 3
    assert paths(done.entries) == sorted([*BASE_PATHS, "C:\\docs\\good"])
    loop = run(spark, base(spark), [rec(1, f(10), f(20), "RENAME_NEW_NAME", "docs", DIR), rec(2, f(20), f(10), "RENAME_NEW_NAME", "archive", DIR)])
    assert loop.rescan_required and paths(loop.entries) == BASE_PATHS


def test_hard_links(spark):
    rows = frame(spark, [root(), entry("a", 10, 5, True), entry("b", 20, 5, True), entry("shared.txt", 100, 10, size=42), entry("alias.txt", 100, 20, size=42, entry_id=101)])
    change = [rec(1, f(100), f(10), "HARD_LINK_CHANGE", "shared.txt")]
    none = run(spark, rows, change)
    assert none.rescan_required and none.stats["hard_link_refresh_failures"] == 1 and paths(none.entries) == paths(rows)
    some = run(spark, rows, change, [(f(100), 50, 1)], [(f(100), f(20), "alias.txt", "present"), (f(100), f(20), "third.txt", "present")])
    assert paths(some.entries) == ["C:", "C:\\a", "C:\\b", "C:\\b\\alias.txt", "C:\\b\\third.txt"]
    assert {r["size"] for r in live(some.entries).where("not is_dir").collect()} == {50}
    gone = run(spark, rows, change, [], [(f(100), None, None, "gone")])
    assert paths(gone.entries) == ["C:", "C:\\a", "C:\\b"] and gone.stats["deleted"] == 2
    # an authoritative set wins over a delete
    kept = run(spark, rows, [rec(1, f(100), f(10), "HARD_LINK_CHANGE|FILE_DELETE", "shared.txt")], [], [(f(100), f(20), "alias.txt", "present")])
    assert "C:\\b\\alias.txt" in paths(kept.entries)
    # a rename among several links needs the old name
    unsure = run(spark, rows, [rec(1, f(100), f(10), "RENAME_NEW_NAME", "new.txt")])
    assert unsure.rescan_required and paths(unsure.entries) == paths(rows)
    sure = run(spark, rows, [rec(1, f(100), f(10), "RENAME_OLD_NAME", "shared.txt"), rec(2, f(100), f(10), "RENAME_NEW_NAME", "new.txt")])
    assert paths(sure.entries) == ["C:", "C:\\a", "C:\\a\\new.txt", "C:\\b", "C:\\b\\alias.txt"]


def test_replaying_a_batch_changes_nothing(spark):
    rng = random.Random(4)
    records = []
    for usn in range(40):
        k = rng.randint(0, 9)
        records.append(rec(usn, f(50 + k), f(rng.choice((5, 10, 20))), rng.choice(("FILE_CREATE", "RENAME_NEW_NAME", "FILE_DELETE", "DATA_EXTEND")), f"n{usn % 7}_{k}"))
    once = run(spark, base(spark), records)
    assert paths(run(spark, once.entries, records).entries) == paths(once.entries)


def test_compaction(spark):
    done = run(spark, base(spark), [rec(1, f(11), f(10), "FILE_DELETE", "note.txt"), rec(2, f(33), f(5), "FILE_CREATE", "z")])
    packed = apply.compact(done.entries)
    assert [(r["entry_id"], r["name"]) for r in packed.orderBy("entry_id").collect()] == [(0, "C:"), (1, "docs"), (2, "archive"), (3, "z")]
    assert apply.compaction_due(100_000, 12_501) and not apply.compaction_due(100_000, 12_500) and not apply.compaction_due(99_999, 50_000)
    assert apply.compaction_due(10, 0, dead_name_bytes=(32 << 20) + 1) and apply.compaction_due(8, 0, appended_names=3)


def test_journal_buffers(spark):
    records = [(7, f(11), f(10), 0x100, 0x20, "Ä𝄞.txt"), (8, f(1 << 15, 60000), f(5), 0x80000000, 0, "")]
    good = journal.encode(9, records)
    assert journal.decode(good) == (9, [(7, f(11), f(10), 0x100, 0x20, "Ä𝄞.txt"), (8, f(1 << 15, 60000) - (1 << 64), f(5), 0x80000000, 0, "")], False)
    assert journal.decode(b"1234")[2] and journal.decode(good[:-3])[2] and journal.decode(good + b"xx")[2]
    other = bytearray(good)
    other[12] = 9
    assert journal.decode(bytes(other))[2]
    rows = journal.records(spark.createDataFrame([(1, good), (2, b"")], "buffer_id long, payload binary")).collect()
    assert [(r["buffer_id"], r["usn"], r["truncated"]) for r in rows] == [(1, 7, False), (1, 8, False), (2, None, True)]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.latest() is None
    with pytest.raises(SnapshotInvalid):
        store.load()
    meta = store.save(base(spark), 1, 10)
    assert (meta.version, meta.n_rows) == (1, 4) and store.load().count() == 4
    base(spark).limit(3).write.mode("overwrite").parquet(f"{store.path}/v=1")
    with pytest.raises(SnapshotInvalid):
        store.load()
    store.save(frame(spark, [root(), entry("lost", 10, 99)]), 1, 11)
    with pytest.raises(SnapshotInvalid):
        store.load()


def test_stream(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.save(base(spark), 1, 0)
    source = f"{tmp_path}/in"
    batches = [[rec(1, f(30), f(10), "FILE_CREATE", "one.txt")], [rec(2, f(30), f(10), "RENAME_NEW_NAME", "two.txt"), rec(3, f(10), f(20), "RENAME_NEW_NAME", "moved", DIR)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(source)
        apply.start(stream, store, f"{tmp_path}/check").awaitTermination()
        assert store.latest().batch_id == n
    assert paths(store.load()) == ["C:", "C:\\archive", "C:\\archive\\moved", "C:\\archive\\moved\\note.txt", "C:\\archive\\moved\\two.txt"]
    meta = store.latest()
    assert meta.next_usn == 4
    # a batch that comes again is known
    assert apply.apply_to_store(store, spark.createDataFrame(batches[1], RECORDS), None, None, 1) == meta
    with pytest.raises(TopologyError):
        apply.apply_to_store(store, spark.createDataFrame([rec(9, f(70), f(99), "FILE_CREATE", "x")], RECORDS), None, None, 2)


def test_decisions():
    q = decisions.EventQueue(size=2)
    for n in range(3):
        q.push(("index_changed", n))
    assert q.dropped == 1 and [e[1] for e in q.events] == [1, 2]
    d = decisions.Debounce(0.2)
    assert [d.passes(t) for t in (0, 0.1, 0.2, 0.3, 0.45)] == [True, False, True, False, True]
    assert decisions.next_state("scanning", "volume_ready") == "ready" and decisions.next_state("ready", "rescan_started") == "rescanning" and decisions.next_state("ready", "volume_failed") == "failed"


def test_engine_installs_every_changed_row(spark):
    """Flags that change without looked-up sizes, of files and directories; batches that change nothing move no generation."""
    from arbordex.engine import Engine

    hidden, is_dir = ATTRIBUTES["HIDDEN"], ATTRIBUTES["DIRECTORY"]

    def record(usn, of, parent, attributes, name, reason="BASIC_INFO_CHANGE"):
        return spark.createDataFrame([(usn, f(of), f(parent), REASONS[reason], attributes, name)], "usn long, frn long, parent_frn long, reason long, attributes long, name string")

    for searched in (True, False):  # with a stored catalogue to keep, and without one
        e = Engine(spark)
        e.attach({"C:": frame(spark, [root(), entry("docs", 10, 5, True), entry("plan.txt", 11, 10), entry("plan_b.txt", 12, 10), entry("other plan", 13, 5)])})

        def names(text="plan"):
            return [r["name"] for r in e.search(text).rows.orderBy("pos").collect()]

        if searched:
            assert names() == ["other plan", "plan.txt", "plan_b.txt"]
        start = e._generations()["C:"]
        e.apply("C:", record(1, 10, 5, is_dir | hidden, "docs"))
        assert names() == ["other plan"]
        assert e._generations()["C:"] == (start[0] + 1, start[1], start[2], start[3] + 1)
        if not searched:
            continue
        e.apply("C:", record(2, 10, 5, is_dir | hidden, "docs"))
        assert e._generations()["C:"] == (start[0] + 1, start[1], start[2], start[3] + 1)
        e.apply("C:", record(3, 10, 5, is_dir, "docs"))
        e.apply("C:", record(4, 11, 10, hidden, "plan.txt"))
        assert names() == ["other plan", "plan_b.txt"]
        e.apply("C:", record(5, 12, 10, 0, "plan_b.txt", "DATA_EXTEND"), spark.createDataFrame([(f(12), 99, 7)], "frn long, size long, mtime_secs long"))
        assert names("size:99 plan") == ["plan_b.txt"]
        e.apply("C:", record(6, 10, 5, is_dir, "papers", "RENAME_NEW_NAME"))
        assert [r["parent_path"] for r in e.page(e.search("plan_b").id, 0).collect()] == ["C:\\papers\\"]
        with pytest.raises(Exception, match="itself"):
            e.search("x")
            e.apply("C:", record(7, 10, 10, is_dir, "papers", "RENAME_NEW_NAME"))


def test_a_batch_keeps_the_parts_that_it_does_not_touch(spark):
    """Pages of a result from before the batch go on, and what nobody reads is deleted."""
    from arbordex.engine import Engine

    e = Engine(spark)
    e.attach({"C:": frame(spark, [root(), *[entry(f"name {n:03}", 100 + n, 5, size=n) for n in range(60)]])})
    old = e.search("name")
    e.apply("C:", spark.createDataFrame([(1, f(130), f(5), REASONS["RENAME_NEW_NAME"], 0, "zebra")], "usn long, frn long, parent_frn long, reason long, attributes long, name string"))
    assert [r["name"] for r in e.page(old.id, 0, 2).collect()] == ["name 000", "name 001"]
    assert [r["name"] for r in e.page(e.search("z").id, 0).collect()] == ["zebra"]
    folders = old.stored.folders()
    for r in list(e._results):
        e.free(r)
    assert e._folders == e.stored().folders() and not folders <= e._folders


def test_batches_are_not_broadcast(spark, capsys):
    """Neither the objects of a batch nor the entries go through the driver, however small Spark takes them for."""
    rows = apply.decide(base(spark), spark.createDataFrame([rec(1, f(10), f(5), "FILE_CREATE", "new")], RECORDS), spark.createDataFrame([], apply.STATS), spark.createDataFrame([], apply.LINKS))
    rows.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_record_number_given_out_twice_in_a_batch(spark):
    """The object that stood under it is dead once, not once for each one that follows."""
    rows = spark.createDataFrame([rec(1, f(60, 2), f(5), "FILE_CREATE", "b"), rec(2, f(60, 3), f(5), "FILE_CREATE", "c")], RECORDS)
    done = apply.apply_batch(frame(spark, [root(), entry("a", 60, 5)]), rows)
    assert sorted((r["name"], r["tombstone"]) for r in done.entries.where("not is_dir").collect()) == [("a", True), ("b", False), ("c", False)]
