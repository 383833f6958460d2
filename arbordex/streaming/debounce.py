"""Debouncing of whole event tables, in blocks of bounded size that carry the last time let through.

A block is a step function from the last time let through before it to the one after it. Neighbouring
functions are composed in a tree of tasks; what each block is entered with comes down the same tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import number
from ..workspace import materialize

#: Rows of a block, whatever group they are of; a task of the two passes holds one block at a time.
BLOCK = 8192
#: Neighbouring functions that a task of the tree composes.
FAN = 16


def _segments(table: pa.Table, keys: list[str]) -> list[tuple[tuple, np.ndarray, int]]:
    """For each group of a block in order: its key, its times without nulls, its number of rows."""
    rows = zip(*(table[k].to_pylist() for k in keys), strict=True) if keys else [()] * table.num_rows
    out, at = [], 0
    for key, same in groupby(rows):
        n = sum(1 for _ in same)
        out.append((key, table["__time"].slice(at, n).drop_null().to_numpy(), n))
        at += n
    return out


def _following(times: np.ndarray, interval: int) -> list[int]:
    """For each place that passes, the place that passes next; len(times) for none."""
    return np.searchsorted(times, times + interval).tolist()


@dataclass(frozen=True)
class _Span:
    """What a stretch of rows does to the last time let through.

    one: all rows are of one group; then the first event to pass, where it is not later than a start, leads
    to that start's exit, and what no start reaches stays as it was. begin is the group's first time there.
    left is the last time let through when nothing was before; with several groups it is so in any case.
    """

    first: tuple
    last: tuple
    one: bool
    begin: int | None
    starts: np.ndarray
    exits: np.ndarray
    left: int | None

    def leave(self, last: int | None, interval: int) -> int | None:
        if last is None or not self.one:
            return self.left
        at = int(np.searchsorted(self.starts, last + interval))
        return int(self.exits[at]) if at < len(self.starts) else last


_NO_TIMES = np.empty(0, np.int64)


def _steps(starts: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring starts with one exit are one; the last of them stands for all."""
    kept = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.empty(0, bool)
    return starts[kept], exits[kept]


def _span(first: tuple, last: tuple, one: bool, times: np.ndarray, interval: int) -> _Span:
    """The span of rows whose last group has these times.

    What passed before is not after times[0], so the first to pass is at times[0] + interval at most.
    """
    n = len(times)
    if not n:
        return _Span(first, last, one, None, _NO_TIMES, _NO_TIMES, None)
    after = _following(times, interval)
    exits = times.tolist()
    for j in range(n - 1, -1, -1):
        if after[j] < n:
            exits[j] = exits[after[j]]
    if not one:
        return _Span(first, last, one, None, _NO_TIMES, _NO_TIMES, exits[0])
    steps = _steps(times[: after[0] + 1].astype(np.int64), np.array(exits[: after[0] + 1], np.int64))
    return _Span(first, last, one, int(times[0]), *steps, exits[0])


def _compose(a: _Span, b: _Span, interval: int) -> _Span:
    """The span of a and then b. It has at most a step for each distinct time of an interval from its begin on."""
    same = a.last == b.first
    if not (same and a.one and b.one):
        return _Span(a.first, b.last, False, None, _NO_TIMES, _NO_TIMES, b.leave(a.left if same else None, interval))
    if not len(a.starts) or not len(b.starts):
        full = a if len(a.starts) else b
        return _Span(a.first, b.last, True, full.begin, full.starts, full.exits, full.left)
    at = np.searchsorted(b.starts, a.exits + interval)
    exits = np.where(at < len(b.starts), b.exits[np.minimum(at, len(b.starts) - 1)], a.exits)
    # what passes a by: from behind its last start to the last place that the first to pass may have
    rest = slice(int(np.searchsorted(b.starts, a.starts[-1], "right")), int(np.searchsorted(b.starts, a.begin + interval)) + 1)
    if a.starts[-1] >= a.begin + interval:
        rest = slice(0, 0)
    steps = _steps(np.append(a.starts, b.starts[rest]), np.append(exits, b.exits[rest]))
    return _Span(a.first, b.last, True, a.begin, *steps, b.leave(a.left, interval))


_LISTED = pa.list_(pa.int64())
_FIGURES = {"one": ("boolean", pa.bool_()), "begin": ("long", pa.int64()), "starts": ("array<long>", _LISTED), "exits": ("array<long>", _LISTED), "left": ("long", pa.int64())}


def _table(unit: int, span: _Span, edges: dict) -> pa.Table:
    """A span as a row; edges are its keys as they were read."""
    figures = {c: pa.array([getattr(span, c)], t) for c, (_, t) in _FIGURES.items()}
    return pa.table({"unit": pa.array([unit], pa.int64()), **figures, **edges})


def _spans(table: pa.Table, keys: list[str]) -> list[_Span]:
    columns = {c: table[c].to_pylist() for c in _FIGURES}
    edges = [[table[f"{edge}_{k}"].to_pylist() for k in keys] for edge in ("first", "last")]
    return [
        _Span(*(tuple(c[i] for c in edge) for edge in edges), columns["one"][i], columns["begin"][i], *(np.array(columns[c][i], np.int64) for c in ("starts", "exits")), columns["left"][i])
        for i in range(table.num_rows)
    ]


def debounced(events: DataFrame, time: str, order: list[str], interval: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """events with pos, their place by keys, time and order, and passes: at most one in an interval per group, at its leading edge.

    time and interval are whole numbers of one unit, interval above 0; keys are not floating. Events
    without a time stand last in their group, have a null in passes and hold nothing back.

    Rows are sorted by ranges and cut into blocks of BLOCK rows, so that neither a large group nor
    one alone makes a task larger. Each block becomes a function (_Span), FAN of them one, and so on up to
    one task; then each is told what it is entered with, down to the blocks, and a last pass marks the rows.
    The driver sees the number of blocks alone. A task of the tree holds FAN functions, each with at most a
    step for each distinct time within one interval, so with interval + 1 steps at most.
    """
    keys = list(keys)
    rows = number(events.withColumn("__time", F.col(time).cast("long")), [*map(F.col, keys), F.col("__time").asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in order)])
    rows = rows.withColumn("__block", F.floor(F.col("pos") / BLOCK))

    schema = T.StructType([T.StructField("unit", T.LongType()), *(T.StructField(c, T.DataType.fromDDL(t)) for c, (t, _) in _FIGURES.items())])
    for k in keys:
        for edge in ("first", "last"):
            schema.add(f"{edge}_{k}", rows.schema[k].dataType)

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        parts = _segments(table, keys)
        span = _span(parts[0][0], parts[-1][0], len(parts) == 1, parts[-1][1], interval)
        edges = {f"{edge}_{k}": table[k].slice(at, 1) for k in keys for edge, at in (("first", 0), ("last", table.num_rows - 1))}
        return _table(table["__block"][0].as_py(), span, edges)

    def join_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        span, *others = _spans(table, keys)
        for other in others:
            span = _compose(span, other, interval)
        edges = {f"{edge}_{k}": table[f"{edge}_{k}"].slice(at, 1) for k in keys for edge, at in (("first", 0), ("last", table.num_rows - 1))}
        return _table(table["__up"][0].as_py(), span, edges)

    def hand_down(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        # what the first one is entered with is of the group before it, or of its own
        last, key, entered = table["__last"][0].as_py(), tuple(table[f"__key_{k}"][0].as_py() for k in keys), []
        for span in _spans(table, keys):
            last = last if key == span.first else None
            entered.append(last)
            last, key = span.leave(last, interval), span.last
        out = {"unit": table["unit"], "__last": pa.array(entered, pa.int64())}
        return pa.table(out | {f"__key_{k}": table[f"first_{k}"] for k in keys})

    def above(level: DataFrame) -> DataFrame:
        return level.withColumn("__up", F.floor(F.col("unit") / FAN))

    slim = rows.select("__block", "pos", "__time", *keys)
    levels = [materialize(slim.groupBy("__block").applyInArrow(summary, schema), "spans")]
    n = levels[0].count()
    while n > FAN:
        levels.append(materialize(above(levels[-1]).groupBy("__up").applyInArrow(join_up, schema), "spans"))
        n = -(-n // FAN)

    told = T.StructType([T.StructField("unit", T.LongType()), T.StructField("__last", T.LongType()), *(T.StructField(f"__key_{k}", rows.schema[k].dataType) for k in keys)])
    entered = None
    for level in reversed(levels):
        if entered is None:  # nothing is before the first one; its own keys stand for those before it
            given = above(level).withColumn("__last", F.lit(None).cast("long")).select("*", *(F.col(f"first_{k}").alias(f"__key_{k}") for k in keys))
        else:
            given = above(level).join(entered.withColumnRenamed("unit", "__up"), "__up")
        entered = materialize(given.groupBy("__up").applyInArrow(hand_down, told), "entered")

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        passes, last = [], table["__last"][0].as_py()
        for _, times, n in _segments(table, keys):
            m, after = len(times), _following(times, interval)
            own = [False] * m
            at = 0 if last is None else int(np.searchsorted(times, last + interval))
            while at < m:
                own[at] = True
                at = after[at]
            passes += own + [None] * (n - m)
            last = None
        return table.drop_columns(["__block", "__time", "__last"]).append_column("passes", pa.array(passes, pa.bool_()))

    before = entered.select(F.col("unit").alias("__block"), "__last")
    out = T.StructType([*(f for f in rows.schema if f.name not in ("__block", "__time")), T.StructField("passes", T.BooleanType())])
    return rows.join(before, "__block").groupBy("__block").applyInArrow(mark, out)
