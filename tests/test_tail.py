"""Following binary buffers into a bucketed store; the engine's generations, events and turns."""

from __future__ import annotations

import os
import random
import threading
import time

import pyarrow as pa
import pytest
from helpers import entry, f, frame, root

from arbordex.engine import Engine
from arbordex.errors import Cancelled, RescanRequired, VolumeUnavailable
from arbordex.functions.scalars import REASONS
from arbordex.sources import journal
from arbordex.sources.snapshots import SnapshotStore
from arbordex.streaming import apply, decisions, tail


def rows_of(df):
    return sorted(tuple(r) for r in df.select("entry_id", "frn", "parent_frn", "name", "tombstone", "size").collect())


def shelf(spark):
    return frame(spark, [root(), *[entry(f"d{k}", 10 + k, 5, True) for k in range(4)], *[entry(f"n{k}", 50 + k, 10 + k % 4, size=k) for k in range(30)]])


def rec(usn, k, reason, name, parent=10):
    return (usn, f(k), f(parent), REASONS[reason], 0, name)


def reads(spark, rows):
    return spark.createDataFrame(rows, tail.READS)


def test_open():
    view = decisions.JournalView(7, 50, 90)
    meta = decisions.Meta(1, decisions.FORMAT, 7, 60, -1, 0, 0)
    assert tail.open_at(meta, view) == tail.Opened("restore", 60)
    assert tail.open_at(None, view) == tail.Opened("scan: first run", 90)
    assert tail.open_at(meta, None) == tail.Opened("scan: journal query failed", None)
    late = decisions.Meta(1, decisions.FORMAT, 7, 49, -1, 0, 0)
    assert tail.open_at(late, view).decision == "scan: checkpoint stale"
    assert decisions.restore_decision(meta, view) == "restore" and decisions.restore_decision(late, view) == "scan: checkpoint stale"


def test_buckets_equal_the_whole(spark, tmp_path):
    """Batches applied to touched buckets give the rows that apply_batch gives over all entries."""
    rng = random.Random(8)
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=8, keep=2)
    store.save(shelf(spark), 7, 0)
    whole = shelf(spark)
    for n in range(3):
        batch = [rec(10 * n + i, rng.choice((50, 51, 90 + n)), rng.choice(("FILE_CREATE", "RENAME_NEW_NAME", "FILE_DELETE")), f"x{n}_{i}", rng.choice((10, 11, 12))) for i in range(3)]
        buffer = journal.encode(10 * n + 9, batch)
        meta = tail.apply_reads(store, reads(spark, [(n, buffer, None)]), None, None, n)
        whole = apply.apply_batch(whole, spark.createDataFrame(batch, "usn long, frn long, parent_frn long, reason long, attributes long, name string")).entries
        assert rows_of(store.load()) == rows_of(whole) and meta.next_usn == 10 * n + 9
    assert {p for p in os.listdir(f"{tmp_path}/s") if p.startswith("m=")} == {"m=3", "m=4"}
    # a change writes few of the buckets
    (writer,) = os.listdir(f"{tmp_path}/s/v=4")
    assert 1 <= len([p for p in os.listdir(f"{tmp_path}/s/v=4/{writer}") if p.startswith("bucket=")]) <= 3
    # a buffer without records moves the cursor alone; records before the cursor are known
    again = tail.apply_reads(store, reads(spark, [(3, journal.encode(40, batch), None)]), None, None, 3)
    assert again.next_usn == 40 and rows_of(store.load()) == rows_of(whole)


def test_conditions(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(RescanRequired):
        tail.follow(None, store, "", decisions.JournalView(7, 0))
    meta = store.save(shelf(spark), 7, 0)
    good = (1, journal.encode(2, [rec(1, 90, "FILE_CREATE", "x")]), None)
    for bad, error in (((2, b"torn", None), RescanRequired), ((2, None, tail.GONE[3]), RescanRequired), ((2, None, "read failed"), VolumeUnavailable)):
        with pytest.raises(error):
            tail.apply_reads(store, reads(spark, [good, bad]), None, None, 0)
        assert store.latest() == meta
    assert tail.apply_reads(store, reads(spark, [good]), None, None, 0).n_rows == meta.n_rows + 1


def test_engine_follows(spark):
    engine = Engine(spark)
    engine.attach({"C:": shelf(spark)})
    shape = "usn long, frn long, parent_frn long, reason long, attributes long, name string"
    v = engine.volumes["C:"]
    before = (v.content, v.stat, v.topology)
    engine.apply("C:", spark.createDataFrame([rec(1, 50, "DATA_EXTEND", "n0")], shape), spark.createDataFrame([(f(50), 99, 0)], apply.STATS))
    assert (v.content, v.stat, v.topology) == (before[0], before[1] + 1, before[2])
    engine.apply("C:", spark.createDataFrame([rec(2, 95, "FILE_CREATE", "new")], shape))
    assert (v.content, v.stat, v.topology) == (before[0] + 1, before[1] + 1, before[2])
    assert engine.search("new").hits == 1
    with pytest.raises(RescanRequired):
        engine.apply("C:", spark.createDataFrame([rec(3, 96, "FILE_CREATE", "lost", 77)], shape))
    assert engine.status() == {"C:": "rescanning"}
    with pytest.raises(VolumeUnavailable):
        engine.search("new")
    engine.rescanned("C:", shelf(spark))
    assert engine.status() == {"C:": "ready"} and engine.search("new").hits == 0
    kinds = [r["kind"] for r in engine.events_table().orderBy("number").collect()]
    assert kinds == ["progress", "volume_ready", "index_changed", "index_changed", "rescan_started", "index_changed", "volume_ready"]


def test_latest_search_wins(spark, monkeypatch):
    from arbordex.operators import search

    engine = Engine(spark)
    engine.attach({"C:": shelf(spark)})
    engine.search("n", tag="window")
    real, inside, go, seen = search.filtered, threading.Event(), threading.Event(), []

    def slow(*a):
        if threading.current_thread() is not threading.main_thread():
            inside.set()
            go.wait(60)
        return real(*a)

    monkeypatch.setattr(search, "filtered", slow)

    def first():
        try:
            engine.search("n1", tag="window")
        except Cancelled as e:
            seen.append(e)

    thread = threading.Thread(target=first)
    thread.start()
    inside.wait(60)
    assert engine.search("n2", tag="window").hits == 11
    go.set()
    thread.join(60)
    assert len(seen) == 1 and engine.metrics.counters["cancelled"] == 1


def test_packing_costs_what_encoding_does():
    """Buffers of one record each, as fast as records are encoded, but for a small factor."""
    rows = [(i, f(i), f(5), 256, 0, f"f_{i}.txt") for i in range(20_000)]
    began = time.process_time()
    plain = [journal.encode(r[0] + 1, [r]) for r in rows]
    middle = time.process_time()
    found = list(journal.packed(rows, 1))
    assert [p for _, p in found] == plain and time.process_time() - middle < 20 * (middle - began)
    cut = list(journal.packed([(i, f(i), f(5), 256, 0, "x") for i in (3, 4, 5, 6, 9, 10)], 3, torn=True))
    assert [(i, [r[0] for r in journal.decode(p)[1]], journal.decode(p)[0], journal.decode(p)[2]) for i, p in cut] == [(3, [3, 4, 5], 6, False), (6, [6], 7, False), (9, [9, 10], 11, False)]
    assert [journal.decode(p)[2] for _, p in journal.packed(rows[:8], 1, torn=True)] == [False, False, False, True] * 2


class Captured:
    """In a DataFrame's place: keeps the function that tasks are to run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run


def test_decoding_hands_on_bounded_batches():
    """However many buffers come at once, a task holds the records of few of them."""
    rows = [(i, f(i), f(5), 256, 0, f"f_{i}.txt") for i in range(40_000)]
    ids, payloads = zip(*journal.packed(rows, 256), strict=True)
    journal.records(at := Captured())
    out = list(at.run([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(payloads)], names=["buffer_id", "payload"])]))
    assert max(b.num_rows for b in out) < journal.BATCH_ROWS + 256
    assert [u for b in out for u in b["usn"].to_pylist()] == list(range(40_000))
