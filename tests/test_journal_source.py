"""The journal as a source: cursors as offsets, restarts, what is gone, what is torn."""

from __future__ import annotations

import os

import pytest
from helpers import entry, f, frame, root

from arbordex.errors import RescanRequired
from arbordex.functions.scalars import REASONS
from arbordex.sources import journal
from arbordex.sources import journal_source as source
from arbordex.sources.snapshots import SnapshotStore
from arbordex.streaming import tail


def put(path, first, after, names, tail_bytes=b""):
    rows = [(first + i, f(100 + first + i), f(5), REASONS["FILE_CREATE"], 0, n) for i, n in enumerate(names)]
    source.write_buffer(path, first, after, journal.encode(after, rows) + tail_bytes)


def names(store):
    return sorted(r["name"] for r in store.load().where("not is_dir").collect())


@pytest.fixture
def place(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=2)
    store.save(frame(spark, [root(), entry("old", 50, 5)]), 7, 2)
    return store, f"{tmp_path}/j", f"{tmp_path}/c"


def test_reader(tmp_path):
    """Without Spark: records from the cursor on, within a buffer too; a gap in the files is a loss."""
    path = f"file:{tmp_path}/j"
    put(path, 0, 4, ["a", "b", "c\ud800"])
    put(path, 4, 9, ["d"])
    put(path, 9, 12, [])
    source.write_status(path, 7, 0, 12)
    reader = source.JournalReader(path, 7, 1, 2)
    assert reader.initialOffset() == {"usn": 1} and reader.latestOffset() == {"usn": 12}
    parts = reader.partitions({"usn": 1}, {"usn": 12})
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 2 and [(r["usn"], r["name"], r["next_usn"]) for r in rows] == [(1, "b", 4), (2, "c?", 4), (4, "d", 9), (None, None, 12)]
    assert reader.partitions({"usn": 12}, {"usn": 12}) == []
    for change in (lambda: os.remove(f"{tmp_path}/j/{4:020}-{9:020}.usn"), lambda: source.write_status(path, 7, 3, 12), lambda: source.write_status(path, 7, 0, 12, tail.GONE[1]), lambda: source.write_status(path, 7, 0, 12, tail.GONE[2]), lambda: source.write_status(path, 8, 0, 12), lambda: os.remove(f"{tmp_path}/j/journal.json")):
        change()
        with pytest.raises(source.JournalGone) as e:
            reader.partitions({"usn": 1}, {"usn": 12})
        assert str(e.value).removeprefix("journal gone: ") in tail.GONE


def test_restart_at_the_cursor(spark, place):
    store, path, checkpoint = place
    put(path, 0, 4, ["known", "known too", "one"])
    source.write_status(path, 7, 0, 4)
    tail.ended(tail.follow_journal(store, path, checkpoint))
    # records before the store's cursor are in it
    assert names(store) == ["old", "one"] and store.latest().next_usn == 4
    put(path, 4, 6, ["two", "three"])
    put(path, 6, 9, [])
    os.remove(f"{path}/{0:020}-{4:020}.usn")
    source.write_status(path, 7, 4, 9)
    tail.ended(tail.follow_journal(store, path, checkpoint))
    meta = store.latest()
    assert names(store) == ["old", "one", "three", "two"] and meta.next_usn == 9
    tail.ended(tail.follow_journal(store, path, checkpoint))
    assert store.latest() == meta
    # a stream without its checkpoint goes on at the store's cursor
    put(path, 9, 10, ["four"])
    source.write_status(path, 7, 9, 10)
    tail.ended(tail.follow_journal(store, path, f"{checkpoint}2", writer="second"))
    assert "four" in names(store)


def test_gone_and_torn(spark, place):
    store, path, checkpoint = place
    meta = store.latest()
    for state in ((8, 0), (7, 3)):
        source.write_status(path, *state, 4)
        with pytest.raises(RescanRequired, match="stale"):
            tail.follow_journal(store, path, checkpoint)
    put(path, 0, 4, ["a", "b", "c"], b"torn")
    source.write_status(path, 7, 0, 4)
    with pytest.raises(RescanRequired, match="malformed"):
        tail.ended(tail.follow_journal(store, path, f"{checkpoint}a"))
    # the journal says that there is more than it has
    put(path, 4, 6, ["d"])
    source.write_status(path, 7, 0, 9)
    with pytest.raises(RescanRequired, match="entry deleted"):
        tail.ended(tail.follow_journal(store, path, f"{checkpoint}b"))
    source.write_status(path, 7, 0, 6, tail.GONE[2])
    with pytest.raises(RescanRequired, match="not active"):
        tail.ended(tail.follow_journal(store, path, f"{checkpoint}c"))
    assert store.latest() == meta
