"""Debouncing of whole tables against the driver's own Debounce, row by row."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from arbordex import registry
from arbordex.streaming import debounce
from arbordex.streaming.decisions import Debounce

#: The query's former SQL as it was; its recursion ends at row 50.
FIRST_ROWS = "WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY event_id) AS i, event_id * 70 AS ms FROM events), d AS (SELECT i, ms, ms AS last, true AS passes FROM e WHERE i = 1 UNION ALL SELECT e.i, e.ms, CASE WHEN e.ms - d.last >= 200 THEN e.ms ELSE d.last END, e.ms - d.last >= 200 FROM d JOIN e ON e.i = d.i + 1 WHERE e.i <= 50) SELECT i, passes FROM d"


def brute(rows, interval):
    """rows: (key, ms, id); by id, whether it passes."""
    gates, out = {}, {}
    for key, ms, id_ in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2])):
        out[id_] = None if ms is None else gates.setdefault(key, Debounce(interval)).passes(ms)
    return out


def test_all_events(spark, sf_dir):
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    gate = Debounce(200)
    got = sorted(tuple(r) for r in registry.BY_TEST["st_debounce"](spark, sf_dir).collect())
    assert got == [(i, gate.passes(n * 70)) for i, n in enumerate(ids, 1)] and len(got) > 50
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    assert got[:50] == sorted(con.execute(FIRST_ROWS).fetchall())


@pytest.mark.parametrize("block", [1, 3, 64])
@pytest.mark.parametrize("gap", [3, 60, 700])
def test_groups_over_blocks(spark, monkeypatch, block, gap):
    """One hot group over many blocks, small ones within a block, equal and missing times, a null key."""
    monkeypatch.setattr(debounce, "BLOCK", block)
    monkeypatch.setattr(debounce, "FAN", 3)
    rng = random.Random(block * gap)
    rows, ms = [], 0
    for n in range(150):
        ms += rng.choice((0, rng.randrange(gap)))
        rows.append((rng.choice(("hot", "hot", "hot", "hot", "a", "b", None)), None if n % 29 == 0 else ms, n))
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "key string, ms long, id long")
    got = debounce.debounced(events, "ms", ["id"], 200, ("key",)).collect()
    assert {r["id"]: r["passes"] for r in got} == brute(rows, 200)
    assert sorted(r["pos"] for r in got) == list(range(150))
    assert sorted((r["key"] or "", r["ms"] or -1, r["id"]) for r in got) == sorted((k or "", m or -1, i) for k, m, i in rows)


def test_empty(spark):
    assert debounce.debounced(spark.createDataFrame([], "ms long, id long"), "ms", ["id"], 200).count() == 0


def test_composed_spans():
    """Any bracketing of neighbouring spans does what the gate does row by row, and has few steps."""
    rng = random.Random(6)
    for trial in range(300):
        interval, n = rng.choice((1, 7, 50, 400)), rng.randrange(1, 40)
        rows = sorted((rng.choice("ab") if trial % 3 == 0 else "a", rng.randrange(rng.choice((5, 60, 900)))) for _ in range(n))
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(6))))
        spans = []
        for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
            part = rows[lo:hi]
            times = np.array([t for k, t in part if k == part[-1][0]], np.int64)
            spans.append(debounce._span((part[0][0],), (part[-1][0],), part[0][0] == part[-1][0], times, interval))
        while len(spans) > 1:
            at = rng.randrange(len(spans) - 1)
            spans[at : at + 2] = [debounce._compose(*spans[at : at + 2], interval)]
        first = rows[0][1]
        for last in (None, *range(first - interval - 2, first + 1)):
            key, now = rows[0][0], last
            for k, t in rows:
                if k != key:
                    key, now = k, None
                if now is None or t - now >= interval:
                    now = t
            assert spans[0].leave(last, interval) == now
        assert len(spans[0].starts) <= interval + 1


def test_dense_burst_over_many_blocks(spark, monkeypatch):
    """All events of many blocks within a few intervals, each time its own; before and behind them thin ones."""
    monkeypatch.setattr(debounce, "BLOCK", 16)
    monkeypatch.setattr(debounce, "FAN", 4)
    rng = random.Random(2)
    times = [0, 150, 380, *range(1000, 3500), 9000, 9100, 9200] + [rng.randrange(1000, 3000) for _ in range(500)]
    rows = [(None, ms, n) for n, ms in enumerate(times)]
    events = spark.createDataFrame([(ms, n) for _, ms, n in rows], "ms long, id long")
    got = debounce.debounced(events, "ms", ["id"], 900).collect()
    assert {r["id"]: r["passes"] for r in got} == brute(rows, 900)
