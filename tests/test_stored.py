"""Stored catalogues after change batches against catalogues that are built anew."""

from __future__ import annotations

import random

import pytest
from helpers import ROOT, entry, f, frame, root

from arbordex.errors import TopologyError
from arbordex.functions.scalars import ATTRIBUTES, REASONS
from arbordex.operators.stored import StoredCatalogue
from arbordex.sources.snapshots import names
from arbordex.streaming.apply import apply_batch

RECORDS = "usn long, frn long, parent_frn long, reason long, attributes long, name string"
STATS = "frn long, size long, mtime_secs long"


def state(c):
    dirs = {tuple(r) for r in c.dirs.rows.select("volume", "frn", "path", "excluded", "chain", "folded", "nfc", "nfc_folded").collect()}
    columns = ["volume", "entry_id", "frn", "parent_frn", "name", "folded", "size", "mtime_secs", "hidden", "is_excluded", "nfc_name"]
    orders = {sort: sorted(map(tuple, r.rows.select(*columns).collect()), key=repr) for sort, r in c.orders.made.items()}
    return dirs, orders


def same(after, entries, part_rows):
    built = StoredCatalogue.build(entries, part_rows=part_rows)
    for sort in after.orders.made:
        built.orders.ranges(sort)
    (dirs, orders), (want_dirs, want_orders) = state(after), state(built)
    assert dirs == want_dirs
    assert orders == want_orders
    for sort, ranges in after.orders.made.items():
        assert ranges.n == built.orders.made[sort].n and sum(p.visible for p in ranges.parts) == sum(p.visible for p in built.orders.made[sort].parts)


def random_tree(rng, n):
    rows, dirs = [root()], [ROOT]
    for i in range(n):
        is_dir = rng.random() < 0.5
        rows.append(entry(f"{'Dir' if is_dir else 'file'} {i}{rng.choice(['', 'é', 'e\u0301'])}", 100 + i, rng.choice(dirs[-12:]), is_dir, rng.randrange(9) * 100, i, hidden=rng.random() < 0.08))
        if is_dir:
            dirs.append(100 + i)
    return rows, dirs


def random_batch(rng, rows, dirs, n, first):
    """Moves, renames, flags, new and deleted entries; moves may ask for loops."""
    parent = {r[2]: (r[4] & (1 << 48) - 1) if r[4] else None for r in rows}
    files = [r[2] for r in rows if not r[6]]
    out = []
    for i in range(n):
        kind = rng.choice(["move", "hide", "new_dir", "new_file", "delete_file", "hide_file", "delete_dir"])
        d, to = rng.choice(dirs[1:]), rng.choice(dirs)
        usn, is_dir = first + i, ATTRIBUTES["DIRECTORY"]
        hidden = ATTRIBUTES["HIDDEN"] if rng.random() < 0.5 else 0
        if kind == "move":
            out.append((usn, f(d), f(to), REASONS["RENAME_NEW_NAME"], is_dir | hidden, f"Moved {usn}"))
        elif kind == "hide":
            out.append((usn, f(d), f(parent[d]), REASONS["BASIC_INFO_CHANGE"], is_dir | hidden, "any"))
        elif kind == "delete_dir":
            out.append((usn, f(d), f(parent[d]), REASONS["FILE_DELETE"], is_dir, "any"))
        elif kind == "delete_file":
            out.append((usn, f(rng.choice(files)), f(ROOT), REASONS["FILE_DELETE"], 0, "any"))
        elif kind == "hide_file":
            x = rng.choice(files)
            out.append((usn, f(x), f(parent[x]), REASONS["BASIC_INFO_CHANGE"], hidden, "any"))
        else:
            out.append((usn, f(5000 + usn), f(to), REASONS["FILE_CREATE"], (is_dir if kind == "new_dir" else 0) | hidden, f"New {usn}"))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    rows, dirs = random_tree(rng, 70)
    entries = frame(spark, rows)
    stored = StoredCatalogue.build(entries, part_rows=25)
    stored.orders.ranges("size")
    for step in range(2):
        batch = random_batch(rng, rows, dirs, 8, 1000 * step)
        done = apply_batch(entries, spark.createDataFrame(batch, RECORDS), spark.createDataFrame([(batch[0][1], 77, 5)], STATS), loops=False)
        if done.changes is None:
            continue
        try:
            stored = stored.changed(done.changes)
        except TopologyError:
            assert apply_batch(entries, spark.createDataFrame(batch, RECORDS)).rescan_required
            continue
        entries = done.entries.select(*names()).cache()
        same(stored, entries, 25)


def rewritten(before, after):
    return len(set(before.parts) - set(after.parts))


def test_a_move_writes_the_stretches_that_it_touches(spark):
    """600 directories in 30 subtrees of 20; moving one rewrites a few of the parts."""
    rows = [root()]
    for top in range(30):
        rows.append(entry(f"top {top}", 1000 * (top + 1), 5, True))
        rows += [entry(f"sub {k}", 1000 * (top + 1) + k, 1000 * (top + 1) + (k - 1 if k % 3 else 0), True) for k in range(1, 20)]
    entries = frame(spark, rows)
    stored = StoredCatalogue.build(entries, part_rows=20)
    record = [(1, f(7000), f(9000), REASONS["RENAME_NEW_NAME"], ATTRIBUTES["DIRECTORY"], "moved")]
    done = apply_batch(entries, spark.createDataFrame(record, RECORDS), loops=False)
    after = stored.changed(done.changes)
    assert len(stored.dirs.parts) > 30 and rewritten(stored.dirs, after.dirs) <= 6
    # entries do not hold paths: the one row that the batch names changes
    assert len(stored.orders.made["name"].parts) > 20 and rewritten(stored.orders.made["name"], after.orders.made["name"]) <= 2
    paths = {r["path"] for r in after.dirs.rows.collect()}
    assert "C:\\top 8\\moved\\sub 3" in paths and not any(p.startswith("C:\\top 6") for p in paths)
    same(after, done.entries, 20)


def test_loops_are_refused(spark):
    entries = frame(spark, [root(), entry("a", 10, 5, True), entry("b", 11, 10, True), entry("c", 12, 11, True)])
    stored = StoredCatalogue.build(entries, part_rows=2)
    for moves in ([(10, 12)], [(10, 11)]):
        batch = [(n, f(d), f(to), REASONS["RENAME_NEW_NAME"], ATTRIBUTES["DIRECTORY"], "x") for n, (d, to) in enumerate(moves)]
        done = apply_batch(entries, spark.createDataFrame(batch, RECORDS), loops=False)
        with pytest.raises(TopologyError):
            stored.changed(done.changes)


def test_no_entries(spark):
    stored = StoredCatalogue.build(frame(spark, []))
    assert stored.orders.hits("").n == 0 and stored.orders.hits("x").page(0).count() == 0
    assert state(stored.changed(frame(spark, []).selectExpr("*", "'after' as side"))) == state(stored)
