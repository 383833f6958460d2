"""The audit of filters against a plain count over all orders."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_operators import LONG, ODD, SCHEMA  # noqa: E402

from arbordex.llm import _hot_keys, filter_audit  # noqa: E402

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    rows = [(d, t or "", s or "") for d, t, s in rows]
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    docs = defaultdict(list)
    for d, t, part in rows:
        words = brute.WORD.findall(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and any(t == u and e is not None and e < d for e, u, _ in rows),
        }
        docs[part].append(({x for x in fails if fails[x]}, d in good, d in toxic))
    out = []
    for part, held in docs.items():
        own, found = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                redundant = sum(x in r[0] for r in held) - len(gone)
                own[x] += len(gone)
                found.append([part, order, step, len(left), len(gone), redundant, sum(r[0] == {x} for r in held), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        out += [(*f, own[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


LABELS = [(5, 1, 0), (6, 0, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (100, None, 1), (205, 1, None), (9999, 1, 1)]


def test_odd_rows_and_hot_keys(spark, monkeypatch):
    extra = [(600 + n, "one text that many rows hold " * 50, f"s{n % 3}") for n in range(40)]
    extra += [(700, f"TEXT number {n} of one id", "s0") for n in range(30)]
    big = [((1 << 53) + 1, "same", "p"), (None, "same", "p"), ((1 << 53) + 2, "same", "p"), (None, "same", "p")]
    rows = [(r[0], r[1], r[3]) for r in ODD] + extra + big
    table = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, source string, kept long, part string, good boolean")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = plain(rows, LABELS)
    assert got(filter_audit.audit(table, labels)) == want
    # the same with hot texts and doc_ids
    monkeypatch.setattr(_hot_keys, "LEAST_HOT", 5)
    assert got(filter_audit.audit(table, labels)) == want
    none = filter_audit.audit(table.where("false"), labels)
    assert none.columns == COLUMNS and none.count() == 0
    assert got(filter_audit.audit(table, labels.where("false"))) == plain(rows, [])


def test_long_texts(spark):
    rows = [(n, t, None) for n, t in enumerate(LONG.values())]
    table = spark.createDataFrame([(*r[:2], "en", *r[2:], 1) for r in rows], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit(table, labels)) == plain(rows, [])


def test_bitmaps_of_any_number_of_rows_and_parts():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 100, 1000):
        parts = np.array([rng.randrange(1 + n // 3) for _ in range(n)], np.int64)
        fails, flags = np.array([rng.randrange(32) for _ in range(n)], np.int64), [np.array([rng.random() < 0.3 for _ in range(n)], bool) for _ in range(2)]
        found = dict(filter_audit.Bitmaps(parts, fails, *flags).counts())
        assert set(found) == set(parts.tolist())
        for p, counts in found.items():
            for s in range(32):
                left = (parts == p) & (fails & s == 0)
                assert counts[:, s].tolist() == [left.sum(), (left & flags[0]).sum(), (left & flags[1]).sum()]


def test_a_task_of_many_parts_gives_its_counts_out_in_between(monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    names = ["part", "fails", "good", "toxic"]
    batches = [pa.RecordBatch.from_arrays([pa.array([f"p{(n + k) % 11}" for n in range(6)]), pa.array([n * k % 32 for n in range(6)], pa.int32()), pa.array([n % 2 == 0 for n in range(6)]), pa.array([True] * 6)], names) for k in range(9)]
    out = list(filter_audit._counted(iter(batches)))
    assert len(out) > 2
    found = defaultdict(int)
    for r in pa.Table.from_batches(out).to_pylist():
        found[r["part"], r["held"]] += r["kept"]
    rows = pa.Table.from_batches(batches).to_pylist()
    assert found == {(p, s): sum(r["part"] == p and r["fails"] & s == 0 for r in rows) for p in {r["part"] for r in rows} for s in range(32)}
