"""Stores with two writers, compaction as buckets are rewritten, commits that end half-way."""

from __future__ import annotations

import os
import random
import threading

import pytest
from helpers import entry, f, frame, root
from pyspark.sql import functions as F

from arbordex.errors import CommitConflict, SnapshotInvalid
from arbordex.functions.scalars import ATTRIBUTES, REASONS
from arbordex.sources.snapshots import SnapshotStore, bucket_of, names
from arbordex.streaming import apply

RECORDS = "usn long, frn long, parent_frn long, reason long, attributes long, name string"


def rec(usn, k, reason, name, parent=10, attributes=0):
    return (usn, f(k), f(parent), REASONS[reason], attributes, name)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), RECORDS)


def shelf(spark, n=30):
    return frame(spark, [root(), *[entry(f"d{k}", 10 + k, 5, True) for k in range(4)], *[entry(f"n{k}", 50 + k, 10 + k % 4, size=k) for k in range(n)]])


def live_names(store):
    return sorted(r["name"] for r in store.load().where("not tombstone and not is_dir").collect())


def bucket(spark, k, n):
    return spark.range(1).select(bucket_of(F.lit(f(k)), n)).first()[0]


def objects_apart(spark, n):
    """Two of the shelf's files in different buckets, and one that shares the first one's."""
    of = {k: bucket(spark, k, n) for k in range(50, 80)}
    a = 50
    return a, next(k for k in of if of[k] != of[a]), next(k for k in of if k != a and of[k] == of[a]), of


def test_commit_is_made_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store._publish(1, "one") and not store._publish(1, "two")
    assert open(f"{tmp_path}/s/commits/{1:020}").read() == "one"
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append(n) if store._publish(2, str(n)) else None) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and open(f"{tmp_path}/s/commits/{2:020}").read() == str(won[0])
    assert [n for n in os.listdir(f"{tmp_path}/s/commits") if "draft" in n] == []


def test_changes_of_other_buckets_go_behind_each_other(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4)
    base = store.save(shelf(spark), 7, 0)
    a, b, beside_a, of = objects_apart(spark, 4)

    def resized(k, size):
        rows = store.read(base.version, [of[k]])
        return rows.selectExpr(*[f"if(frn = {f(k)}, {size}L, size) AS size" if c == "size" else c for c in names()])

    # both were made from the first version
    store.save(resized(a, 777), 7, 5, 0, [of[a]], base, "one", topology=False)
    meta = store.save(resized(b, 888), 7, 3, 0, [of[b]], base, "two", topology=False)
    sizes = {r["frn"]: r["size"] for r in store.load().collect()}
    assert (sizes[f(a)], sizes[f(b)]) == (777, 888) and len(sizes) == base.n_rows
    assert (meta.version, meta.next_usn, meta.batches) == (3, 5, {"": -1, "one": 0, "two": 0})
    folders = sorted(os.listdir(f"{tmp_path}/s/v=2"))
    for save in (
        lambda: store.save(resized(beside_a, 9), 7, 6, 1, [of[beside_a]], base, "two", topology=False),  # a bucket that changed
        lambda: store.save(shelf(spark), 7, 6, 1, None, base, "two"),  # all rows
        lambda: store.save(resized(b, 9), 7, 6, 0, [of[b]], base, "two", topology=False),  # a batch that is there
        lambda: store.save(resized(a, 9), 7, 6, 1, [3 - of[a]], base, "one", topology=True),  # a change of directories
    ):
        with pytest.raises(CommitConflict):
            save()
    # nothing of them stays
    assert store.latest() == meta and sorted(os.listdir(f"{tmp_path}/s/v=2")) == folders


def test_ids_are_given_out_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4)
    base = store.save(shelf(spark), 7, 0)
    a, b, _, of = objects_apart(spark, 4)
    new = {k: frame(spark, [entry(f"new{k}", k, 10, entry_id=base.last_id + 1)]) for k in (a, b)}
    store.save(store.read(base.version, [of[a]]).unionByName(new[a]), 7, 1, 0, [of[a]], base, "one", topology=False)
    with pytest.raises(CommitConflict):
        store.save(store.read(base.version, [of[b]]).unionByName(new[b]), 7, 1, 0, [of[b]], base, "two", topology=False)


def test_two_writers_lose_nothing(spark, tmp_path):
    """Two threads with batches of their own, some on the same objects' buckets, some of new directories."""
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=4, keep=3)
    store.save(shelf(spark), 7, 0)
    failed = []

    def work(w):
        try:
            for n in range(3):
                made = 200 + 100 * w + n
                apply.apply_to_store(
                    store,
                    batch(spark, rec(10 * n, made, "FILE_CREATE", f"made{made}"), rec(10 * n + 1, 50 + 2 * n + w, "FILE_DELETE", "x"), rec(10 * n + 2, 400 + made, "FILE_CREATE", f"dir{made}", 5, ATTRIBUTES["DIRECTORY"])),
                    None, None, n, writer=f"w{w}",
                )
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert failed == []
    meta = store.latest()
    assert meta.version == 7 and meta.batches == {"": -1, "w0": 2, "w1": 2}
    rows = store.load().where("not tombstone").collect()
    ids = [r["entry_id"] for r in rows]
    assert len(ids) == len(set(ids))
    want = [f"n{k}" for k in range(6, 30)] + [f"made{200 + 100 * w + n}" for w in range(2) for n in range(3)]
    assert live_names(store) == sorted(want)
    assert sum(r["name"].startswith("dir") for r in rows) == 6
    # what comes again is known, whoever wrote last
    assert apply.apply_to_store(store, batch(spark, rec(1, 999, "FILE_CREATE", "late")), None, None, 2, writer="w0") == meta


def test_parents_from_other_buckets(spark, tmp_path):
    """A batch reads the parents it names wherever they lie, all directories only where one moves, and refuses loops."""
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=8)
    store.save(shelf(spark), 7, 0)
    directory = ATTRIBUTES["DIRECTORY"]
    apply.apply_to_store(store, batch(spark, *[rec(k, 300 + k, "FILE_CREATE", f"c{k}", 10 + k) for k in range(4)]), None, None, 0)
    assert [n for n in live_names(store) if n[0] == "c"] == ["c0", "c1", "c2", "c3"]
    apply.apply_to_store(store, batch(spark, rec(10, 11, "RENAME_NEW_NAME", "moved", 10, directory)), None, None, 1)
    with pytest.raises(apply.RescanRequired):
        apply.apply_to_store(store, batch(spark, rec(11, 10, "RENAME_NEW_NAME", "loop", 11, directory)), None, None, 2)
    with pytest.raises(apply.RescanRequired):
        apply.apply_to_store(store, batch(spark, rec(11, 500, "FILE_CREATE", "lost", 77)), None, None, 2)
    meta = store.latest()
    links = spark.createDataFrame([(f(50), f(12), "one", "present"), (f(50), f(13), "two", "present"), (f(51), f(99), "not asked", "present")], apply.LINKS)
    apply.apply_to_store(store, batch(spark, rec(12, 50, "HARD_LINK_CHANGE", "n0", 10)), None, links, 2)
    assert {"one", "two", "n1"} <= set(live_names(store)) and "n0" not in live_names(store)
    assert store.latest().topology == meta.topology


def test_dead_rows_go_as_buckets_are_rewritten(spark, tmp_path):
    """Many batches keep commits, manifests and dead rows few; a store that keeps its dead rows has the same live ones."""
    rng = random.Random(4)
    lean = SnapshotStore(spark, f"file://{tmp_path}/a", buckets=2, keep=2, dead_share=0.25, least_rows=0)
    full = SnapshotStore(spark, f"file://{tmp_path}/b", buckets=2, keep=2, dead_share=None)
    for store in (lean, full):
        store.save(shelf(spark), 7, 0)
    for n in range(8):
        rows = [rec(10 * n + i, rng.randrange(50, 90), rng.choice(("FILE_CREATE", "FILE_DELETE")), f"x{n}_{i}", rng.choice((10, 11, 12))) for i in range(6)]
        for store in (lean, full):
            apply.apply_to_store(store, batch(spark, *rows), None, None, n)
        for p in lean._manifest(lean.latest()):
            assert p["dead"] <= 0.25 * p["n_rows"]
    shape = ["entry_id", "frn", "parent_frn", "name", "size"]
    got, kept = (sorted(tuple(r) for r in s.load().where("not tombstone").select(*shape).collect()) for s in (lean, full))
    assert got == kept and lean.latest().n_rows < full.latest().n_rows and lean.latest().last_id == full.latest().last_id
    for place in "ab":
        assert sorted(os.listdir(f"{tmp_path}/{place}/commits")) == [f"{v:020}" for v in (8, 9)]


def test_writers_that_end_half_way(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=2, keep=2)
    meta = store.save(shelf(spark), 7, 0)
    shelf(spark).write.partitionBy("tombstone").parquet(f"{store.path}/v=2/lost")
    assert store.latest() == meta and store.vacuum(3600.0) == []
    assert store.vacuum(-60.0) == ["v=2/lost"]
    assert store.load().count() == meta.n_rows
    for n in range(3):
        store.save(shelf(spark), 7, n)
    with pytest.raises(SnapshotInvalid):
        store.load(meta)
    # a deletion that ended before the commit's is taken up again
    open(f"{tmp_path}/s/commits/{1:020}", "w").write(open(f"{tmp_path}/s/commits/{4:020}").read().replace("m=4", "m=1"))
    store.save(shelf(spark), 7, 9)
    assert store._commits() == [4, 5]
