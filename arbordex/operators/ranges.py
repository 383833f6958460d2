"""Rows kept in an order: ranges of bounded size that pages seek and changes merge into.

A version is a list of parts, which follow each other in the order of (key, ties). A part is a folder of
rows with its lower bound and its counts, so a place in the order is found in the counts and only its
part is read. A change finds the parts of its rows by their bounds, rewrites these, and gives a new
version; the other parts are shared with the version before.

Descending pages turn the key and the last tie, but not the first tie. So the rows of one key lie in one
part, or, if they are too many, in parts of their own (pure), each of one value of the first tie; then
the parts have an order in either direction.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import drop_at_end, materialize, temporary_path
from .ranks import number

#: Rows of a part, about; a part that changes have made twice as large is divided.
PART_ROWS = 1 << 17
#: Parts below and above every value.
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
#: The bound below all keys.
_FIRST = (0,)


@dataclass(frozen=True)
class Part:
    """number names its rows; low is (0,) for the first part, else (1, key, first tie, last tie)."""

    number: int
    low: tuple
    #: the value of the first tie of a part that holds one key alone
    pure: int | None = None
    folder: str | None = None
    n: int = 0
    visible: int = 0


@dataclass(frozen=True)
class Order:
    """What rows are ordered by, and which of them count as visible (a condition)."""

    key: str
    ties: tuple[str, str] = ("volume_ord", "entry_id")
    visible: str = "not is_excluded"
    part_rows: int = PART_ROWS

    def columns(self, desc: bool = False) -> list:
        first, last = map(F.col, self.ties)
        return [F.col(self.key).desc(), first, last.desc()] if desc else [F.col(self.key), first, last]


def _cuts(fixed: DataFrame, order: Order, one_key: bool) -> list[tuple[tuple, int, int | None]]:
    """(low, place, pure) of the parts of numbered rows; the driver gets rows in proportion to the parts."""
    half = max(1, order.part_rows // 2)
    # a key with more than half a part's rows stands at one of these places
    keys = fixed.where(F.col("__pos") % half == 0).select(order.key).distinct()
    runs = fixed.join(F.broadcast(keys), order.key, "left_semi").groupBy(order.key, order.ties[0]).agg(F.min("__pos").alias("at"), F.count(F.lit(1)).alias("n"))
    by_key: dict[object, list[tuple[int, int, int]]] = {}
    for r in sorted(runs.collect(), key=lambda r: r["at"]):
        by_key.setdefault(r[order.key], []).append((r[order.ties[0]], r["at"], r["n"]))
    hot = {k for k, found in by_key.items() if one_key or sum(x[2] for x in found) > half}
    inner = [at + i for k in hot for _, at, n in by_key[k] for i in range(order.part_rows, n, order.part_rows)]
    places = fixed.sparkSession.createDataFrame([(p,) for p in inner], "__pos long")
    last = dict(map(tuple, fixed.join(F.broadcast(places), "__pos").select("__pos", order.ties[1]).collect())) if inner else {}
    out: list[tuple[tuple, int, int | None]] = []

    def add(low: tuple, at: int, pure: int | None) -> None:
        if out and out[-1][1] == at and out[-1][2] is None and pure is None:
            return  # nothing lies between: the part before takes both
        out.append((low, at, pure))

    add(_FIRST, 0, None)
    for k, found in by_key.items():
        if k not in hot:
            add((1, k, _LOWEST, _LOWEST), found[0][1], None)
            continue
        for nth, (tie, at, n) in enumerate(found):
            add((1, k, tie if nth else _LOWEST, _LOWEST), at, tie)
            for i in range(order.part_rows, n, order.part_rows):
                add((1, k, tie, last[at + i]), at + i, tie)
        add((1, k, _HIGHEST, _HIGHEST), found[-1][1] + found[-1][2], None)
    return [c for c in out if c[2] is not None] if one_key else out


def _dealt(rows: DataFrame, order: Order, first: int, one_key: bool = False) -> tuple[DataFrame, list[Part]]:
    """rows with __part, and the parts, still empty, that they are for, numbered from first; one_key makes all of them pure."""
    n = rows.count()
    if n <= order.part_rows and not one_key:
        return rows.withColumn("__part", F.lit(first).cast("long")), [Part(first, _FIRST)]
    fixed = number(rows, order.columns(), "__pos")
    cuts = _cuts(fixed, order, one_key)
    cell = max(1, order.part_rows // 2)
    spans, parts = [], []
    for i, (low, at, pure) in enumerate(cuts):
        stop = cuts[i + 1][1] if i + 1 < len(cuts) else n
        parts.append(Part(first + i, low, pure))
        spans += [(c, first + i, at, stop) for c in range(at // cell, -(-stop // cell)) if stop > at]
    # in proportion to the parts: each has about two cells
    spans = rows.sparkSession.createDataFrame(spans, "__cell long, __part long, __from long, __to long")
    placed = fixed.withColumn("__cell", F.floor(F.col("__pos") / cell)).join(F.broadcast(spans), "__cell").where("__pos >= __from and __pos < __to")
    return placed.drop("__cell", "__from", "__to", "__pos"), parts


class Ranges:
    """One version of ordered rows."""

    def __init__(self, spark: SparkSession, path: str, order: Order, schema, parts: list[Part]):
        self.spark, self.path, self.order, self.schema, self.parts = spark, path, order, schema, parts
        self.next = 1 + max((p.number for p in parts), default=-1)

    @classmethod
    def build(cls, rows: DataFrame, order: Order, label: str = "order", under: str | None = None) -> Ranges:
        """The first version, in a folder under another, or in one of its own that goes when the application ends."""
        spark = rows.sparkSession
        path = f"{under}/{label}" if under else drop_at_end(spark, temporary_path(spark, label))
        empty = cls(spark, path, order, rows.schema, [])
        dealt, parts = _dealt(rows, order, 0)
        return cls(spark, path, order, rows.schema, empty._written(dealt, parts))

    def _written(self, dealt: DataFrame, parts: list[Part]) -> list[Part]:
        """parts with the folders and counts of their rows, which are written."""
        at = f"{self.path}/{temporary_path(self.spark, 'v').rpartition('/')[2]}"
        dealt.withColumn("__in", F.col("__part")).repartition("__in").write.partitionBy("__in").parquet(at)
        back = self.spark.read.schema(dealt.select(*self.schema.names, "__part").schema).parquet(at)
        # one row for each part
        counts = {r["__part"]: r for r in back.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(self.order.visible)).alias("visible"), F.min(self.order.ties[0]).alias("least"), F.max(self.order.ties[0]).alias("most")).collect()}
        out = []
        for p in parts:
            c = counts.get(p.number)
            out.append(replace(p, folder=f"{at}/__in={p.number}", n=c["n"], visible=c["visible"]) if c else replace(p, folder=None, n=0, visible=0))
        self._mixed = {k for k, c in counts.items() if c["least"] != c["most"]}
        return out

    def _read(self, parts: list[Part]) -> DataFrame:
        folders = [p.folder for p in parts if p.folder]
        schema = T.StructType([*self.schema.fields, T.StructField("__part", T.LongType())])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @cached_property
    def rows(self) -> DataFrame:
        """All rows, with __part."""
        return self._read(self.parts)

    def turned(self, desc: bool) -> list[Part]:
        """The parts in the order of either direction."""
        if not desc:
            return self.parts
        out: list[Part] = []
        run: list[Part] = []
        for p in [*self.parts, None]:
            if run and (p is None or p.pure is None or p.low[1] != run[0].low[1]):
                # parts of one key: the first tie upwards, the last downwards
                out += [x for tie in sorted({x.pure for x in run}, reverse=True) for x in run if x.pure == tie]
                run = []
            if p is not None:
                (run if p.pure is not None else out).append(p)
        return out[::-1]

    def slice(self, counts: dict[int, int], offset: int, n: int, desc: bool = False) -> tuple[list[Part], int]:
        """The parts that hold places offset to offset + n - 1, and how many places lie before the first of them.

        counts: how many rows of each part take part.
        """
        chosen, before, at = [], 0, 0
        for p in self.turned(desc):
            here = counts.get(p.number, 0)
            if here and at < offset + n and at + here > offset:
                if not chosen:
                    before = at
                chosen.append(p)
            at += here
        return chosen, before

    def read(self, parts: list[Part]) -> DataFrame:
        """The rows of some parts."""
        return self._read(parts)

    def _located(self, rows: DataFrame) -> DataFrame:
        """rows with __part, by the bounds."""
        lows, numbers = [p.low for p in self.parts], [p.number for p in self.parts]
        key, ties = self.order.key, self.order.ties

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in (key, *ties)), strict=True)
                found = [numbers[bisect_right(lows, (1, *p)) - 1] for p in places]
                yield batch.append_column("__part", pa.array(found, pa.int64()))

        schema = rows.withColumn("__part", F.lit(0).cast("long")).schema
        return rows.mapInArrow(locate, schema)

    def merge(self, removed: DataFrame, added: DataFrame) -> Ranges:
        """The next version, without the removed rows (known by key and ties) and with the added ones.

        Only the parts that either lies in are read and written. A row that is removed and added is changed.
        """
        order = self.order
        gone = materialize(self._located(removed.select(order.key, *order.ties)), "gone")
        fresh = materialize(self._located(added.select(*self.schema.names)), "fresh")
        touched = {r[0] for r in gone.select("__part").unionByName(fresh.select("__part")).distinct().collect()}  # in proportion to the parts
        if not touched:
            return self
        held = self._read([p for p in self.parts if p.number in touched])
        names = [*self.schema.names, "__part"]
        kept = held.join(gone.select("__part", *order.ties).distinct(), ["__part", *order.ties], "left_anti").select(*names)
        after = Ranges(self.spark, self.path, order, self.schema, self.parts)
        new = {p.number: p for p in after._written(kept.unionByName(fresh.select(*names)), [p for p in self.parts if p.number in touched])}
        mixed = after._mixed
        parts: list[Part] = []
        for p in self.parts:
            p = new.get(p.number, p)
            if p.number in touched and (p.n > 2 * order.part_rows or p.pure is not None and p.number in mixed):
                dealt, own = _dealt(self._read([p]).drop("__part"), order, after.next, p.pure is not None)
                after.next += len(own)
                own[0] = replace(own[0], low=p.low)
                parts += after._written(dealt, own)
            else:
                parts.append(p)
        return Ranges(self.spark, self.path, order, self.schema, parts)

    @property
    def n(self) -> int:
        return sum(p.n for p in self.parts)

