"""Ordered results and pages over stored orders: a search counts, a page seeks.

A search counts its hits in each part of the order that it asks for and sorts nothing. A page finds its
parts in these counts, filters them again and sorts their rows alone, so a page deep in a result costs
what the first one does. The counts of a query that every row matches are stored with the parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import limits
from ..errors import InvalidArgument
from ..plans.compiler import Options, Plan, compile_query
from . import search
from .ranges import PART_ROWS, Order, Ranges
from .search import Catalogue
from .statistics import live

KEYS = {"name": "folded", "size": "size", "mtime": "mtime_secs"}


@dataclass(frozen=True)
class Hits:
    """A search's result: how many rows of each part of an order match."""

    plan: Plan
    ranges: Ranges
    paths: DataFrame
    counts: dict[int, int]

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    @property
    def desc(self) -> bool:
        return self.plan.options.desc

    def rows(self, parts=None) -> DataFrame:
        """The matching rows of some parts (of those that have any)."""
        parts = [p for p in self.ranges.parts if self.counts.get(p.number)] if parts is None else parts
        return search.filtered(Catalogue(self.ranges.read(parts).drop("__part").withColumn("tombstone", F.lit(False)), self.paths), self.plan)

    def numbered(self, offset: int, n: int) -> DataFrame:
        """The rows at places offset to offset + n - 1, with pos; their parts alone are read."""
        if offset < 0 or n < 0:
            raise InvalidArgument("negative offset or count")
        parts, before = self.ranges.slice(self.counts, offset, n, self.desc)
        order = self.ranges.order.columns(self.desc)
        rows = self.rows(parts).orderBy(*order).limit(offset - before + n)
        # no more rows than the parts of a page and the page have
        placed = rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long") - 1 + before)
        return placed.where(F.col("pos") >= offset)

    def positions(self) -> DataFrame:
        """All rows with pos: each part is sorted by itself, and the counts tell what comes before it."""
        at, before = 0, []
        for p in self.ranges.turned(self.desc):
            if here := self.counts.get(p.number):
                before.append((p.number, at))
                at += here
        held = self.ranges.read([p for p in self.ranges.parts if self.counts.get(p.number)]).withColumn("tombstone", F.lit(False))
        rows = search.filtered(Catalogue(held, self.paths), self.plan)
        offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")  # a row for each part
        place = F.row_number().over(Window.partitionBy("__part").orderBy(*self.ranges.order.columns(self.desc)))
        return rows.join(F.broadcast(offsets), "__part").withColumn("pos", F.col("__before") + place - 1).drop("__part", "__before")

    def page(self, offset: int, n: int = limits.MAX_PAGE_ROWS) -> DataFrame:
        """The boundary rows of a page; n is held at the page limit, past the end is empty.

        A page's rows, 64 at most, come to the driver, so that of the directories only theirs are read.
        """
        if offset < 0 or n < 0:
            raise InvalidArgument("negative offset or count")
        n = min(n, limits.MAX_PAGE_ROWS)
        parts, before = self.ranges.slice(self.counts, offset, n, self.desc)
        rows = self.rows(parts)
        found = rows.orderBy(*self.ranges.order.columns(self.desc)).offset(offset - before).limit(n).collect() if parts else []
        here = rows.sparkSession.createDataFrame([(*r, offset + i) for i, r in enumerate(found)], T.StructType([*rows.schema.fields, T.StructField("pos", T.LongType())]))
        parents = sorted({r["parent_frn"] for r in found if r["parent_frn"] is not None})
        return search.projected(here, F.broadcast(self.paths.where(F.col("frn").isin(parents))))


class StoredOrders:
    """The live rows of a catalogue in the orders that searches ask for; each order is made at its first use."""

    def __init__(self, catalogue: Catalogue, part_rows: int = PART_ROWS, made: dict[str, Ranges] | None = None, under: str | None = None):
        self.catalogue, self.part_rows, self.made, self.under = catalogue, part_rows, made or {}, under

    def ranges(self, sort: str) -> Ranges:
        if sort not in self.made:
            rows = live(self.catalogue.entries).drop("tombstone")
            self.made[sort] = Ranges.build(rows, Order(KEYS[sort], part_rows=self.part_rows), f"by-{sort}", self.under)
        return self.made[sort]

    def hits(self, text: str | Plan, options: Options = Options(), within: Hits | None = None) -> Hits:
        """The hits of a query in the order of its options; within is a result that is known to have them all."""
        plan = text if isinstance(text, Plan) else compile_query(text, options)
        ranges = self.ranges(plan.options.sort)
        if plan.matches_all:
            hidden = plan.options.include_hidden_system
            return Hits(plan, ranges, self.catalogue.paths, {p.number: p.n if hidden else p.visible for p in ranges.parts})
        parts = ranges.parts
        if within is not None and within.ranges is ranges:
            parts = [p for p in parts if within.counts.get(p.number)]
        rows = ranges.rows if len(parts) == len(ranges.parts) else ranges.read(parts)
        found = search.filtered(Catalogue(rows.withColumn("tombstone", F.lit(False)), self.catalogue.paths), plan).groupBy("__part").count()
        return Hits(plan, ranges, self.catalogue.paths, dict(map(tuple, found.collect())))  # one row for each part

    def changed(self, removed: DataFrame, added: DataFrame, catalogue: Catalogue) -> StoredOrders:
        """The orders after a change: rows of the catalogue that are gone or were different, and rows that are new or differ."""
        made = {sort: ranges.merge(removed, added) for sort, ranges in self.made.items()}
        return StoredOrders(catalogue, self.part_rows, made, self.under)
