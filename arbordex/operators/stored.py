"""A catalogue that is kept in its orders and follows change batches at their own cost.

Directories lie in the order of their chains (the references of all ancestors, in links of one length),
so what is below a directory is one stretch of that order. A batch that moves, hides, makes or removes
directories selects these stretches, closes their paths again on top of what stands above them, and
writes the parts that they leave and enter. Entries change in their orders where the batch names them or
where the visibility of their directory turned. What a batch names is written before it is joined, so
that Spark knows its size and sends it to all tasks or shuffles it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TopologyError
from ..functions.fold import fold
from ..workspace import drop_at_end, drop_now, materialize, owned, temporary_path
from . import search, tree
from .pages import KEYS, StoredOrders
from .ranges import PART_ROWS, Order, Part, Ranges
from .search import Catalogue
from .statistics import live

#: Stretches of the directories' order up to so many are looked up by their bounds, for more all parts are read.
STRETCHES = 1_000
_ID = ["volume", "frn"]


def _labels(dirs: DataFrame, closed: DataFrame) -> DataFrame:
    """The rows of the directories' order: what stands in a directory's entry, and what was closed."""
    own = dirs.select("volume", "volume_ord", "frn", "parent_frn", "name", (F.col("hidden") | F.col("system")).alias("own_excluded"))
    return own.join(closed, _ID)


def _parts_of(ranges: Ranges, chains: list[str]) -> list[Part]:
    """The parts that hold rows whose chain begins with one of some."""
    lows = [p.low for p in ranges.parts]
    found = []
    for i, p in enumerate(ranges.parts):
        after = lows[i + 1] if i + 1 < len(lows) else None
        # keys of p lie between its bound and the next one, either included
        if any((after is None or (1, c) <= after[:2]) and p.low[:2] <= (1, c + "~") for c in chains):
            found.append(p)
    return found


def _below(ranges: Ranges, tops: DataFrame) -> DataFrame:
    """The rows whose chain begins with one of tops (volume, chain)."""
    few = [r["chain"] for r in tops.select("chain").distinct().limit(STRETCHES + 1).collect()]
    rows = ranges.read(_parts_of(ranges, few)) if len(few) <= STRETCHES else ranges.rows
    depth = F.floor(F.length("chain") / tree.LINK)
    prefixes = F.transform(F.sequence(F.lit(1).cast("long"), depth), lambda i: F.substring("chain", F.lit(1), (i * tree.LINK).cast("int")))
    hit = rows.select(*_ID, F.explode(prefixes).alias("top")).join(tops.select("volume", F.col("chain").alias("top")).distinct(), ["volume", "top"], "left_semi")
    return rows.join(hit.select(*_ID).distinct(), _ID, "left_semi").drop("__part")


def relabel(ranges: Ranges, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) rows of the directories' order for directories that were and are (rows of entries).

    Work is in proportion to what is below them; only the search for their chains reads two columns of
    all directories. What lies in a directory that is gone hangs at its volume's root, until a directory
    with that reference comes again. TopologyError where a directory comes to stand below itself.
    """
    touched = materialize(before.select(*_ID).unionByName(after.select(*_ID)).distinct(), "touched")
    known = ranges.rows.select(*_ID, "parent_frn", "chain")
    children = known.join(touched.withColumnRenamed("frn", "parent_frn"), ["volume", "parent_frn"], "left_semi")
    tops = materialize(known.join(touched, _ID, "left_semi").unionByName(children).select("volume", "chain"), "tops")
    old = materialize(_below(ranges, tops), "affected")
    own = (F.col("hidden") | F.col("system")).alias("own_excluded")
    columns = ["volume", "volume_ord", "frn", "parent_frn", "name", "own_excluded"]
    new = materialize(old.join(touched, _ID, "left_anti").select(*columns).unionByName(after.select(*columns[:-1], own)), "moved")
    inside = new.select("volume", F.col("frn").alias("parent_frn"), F.lit(True).alias("__inside"))
    placed = new.join(inside, ["volume", "parent_frn"], "left")
    # what stands above the stretches: labels of directories that the batch leaves as they are
    asked = placed.where("__inside is null and parent_frn is not null").select("volume", F.col("parent_frn").alias("frn")).distinct().join(touched, _ID, "left_anti")
    above = ranges.rows.join(asked, _ID, "left_semi").select("volume", F.col("frn").alias("parent_frn"), F.col("path").alias("a_path"), F.col("chain").alias("a_chain"), F.col("excluded").alias("a_excluded"))
    placed = materialize(placed.join(above, ["volume", "parent_frn"], "left").withColumn("up", F.when(F.col("__inside"), F.col("parent_frn"))), "placed")
    lost = F.col("up").isNull() & F.col("parent_frn").isNotNull() & F.col("a_path").isNull()
    if not placed.where(lost).isEmpty():
        # one row for each volume
        roots = ranges.rows.where(F.length("chain") == tree.LINK).join(new.select(*_ID), _ID, "left_anti").select("volume", F.lit(None).cast("long").alias("r_up"), F.col("path").alias("r_path"), F.col("chain").alias("r_chain"), F.col("excluded").alias("r_excluded"))
        moved_roots = new.where("parent_frn is null").select("volume", F.col("frn").alias("r_up"))
        placed = placed.join(F.broadcast(roots.unionByName(moved_roots, allowMissingColumns=True)), "volume", "left").withColumn("__lost", lost)
        took = {"up": "r_up", "a_path": "r_path", "a_chain": "r_chain", "a_excluded": "r_excluded"}
        placed = placed.select(*_ID, "name", "own_excluded", *[F.when(F.col("__lost"), F.col(r)).otherwise(F.col(c)).alias(c) for c, r in took.items()])
    outside = F.col("up").isNull()
    state = placed.select(
        *_ID, "up",
        F.when(outside, tree.below("a_path", F.col("name"))).otherwise(F.col("name")).alias("path"),
        (F.col("own_excluded") | F.coalesce(F.col("a_excluded") & outside, F.lit(False))).alias("excluded"), F.lit(False).alias("orphan"),
        F.concat(F.when(outside, F.coalesce("a_chain", F.lit(""))).otherwise(F.lit("")), tree.link(F.col("frn"))).alias("chain"),
    )
    closed, looping = tree.close_states(state)
    if not looping.isEmpty():
        raise TopologyError("a directory below itself")
    added = new.join(closed.select(*_ID, "path", "excluded", "chain"), _ID)
    return old, materialize(search.spell_paths(added), "labels")


@dataclass(frozen=True)
class StoredCatalogue:
    """One version: directories in the order of their chains, live entries in the orders that were asked for."""

    dirs: Ranges
    orders: StoredOrders

    @classmethod
    def build(cls, raw: DataFrame, strict: bool = False, part_rows: int = PART_ROWS) -> StoredCatalogue:
        """From entries of the snapshot columns; what it makes on the way is deleted.

        All versions lie under one folder, which goes when the application ends.
        """
        under = drop_at_end(raw.sparkSession, temporary_path(raw.sparkSession, "stored"))
        with owned() as made:
            built = search.build(raw, strict)
            dirs = Ranges.build(_labels(live(built.entries).where("is_dir"), built.paths), Order("chain", ("volume_ord", "frn"), "not excluded", part_rows), "directories", under)
            by_name = Ranges.build(live(built.entries).drop("tombstone"), Order(KEYS["name"], part_rows=part_rows), "by-name", under)
        drop_now(raw.sparkSession, made)
        return cls._of(dirs, {"name": by_name}, part_rows, under)

    @classmethod
    def _of(cls, dirs: Ranges, made: dict[str, Ranges], part_rows: int, under: str) -> StoredCatalogue:
        entries = made["name"].rows.drop("__part").withColumn("tombstone", F.lit(False))
        return cls(dirs, StoredOrders(Catalogue(entries, dirs.rows.drop("__part")), part_rows, made, under))

    @cached_property
    def catalogue(self) -> Catalogue:
        return self.orders.catalogue

    def folders(self) -> set[str]:
        """The folders that this version reads."""
        return {p.folder for r in (self.dirs, *self.orders.made.values()) for p in r.parts if p.folder}

    def changed(self, changes: DataFrame) -> StoredCatalogue:
        """The next version after a batch's changes (see Applied); TopologyError leaves this one as it is."""
        with owned() as made:
            after = self._changed(changes)
        drop_now(changes.sparkSession, made)
        return after

    def _changed(self, changes: DataFrame) -> StoredCatalogue:
        sides = [materialize(changes.where(F.col("side") == side).drop("side"), side) for side in ("before", "after")]
        before, after = (s.where("is_dir") for s in sides)
        dirs, flips = self.dirs, None
        if not before.unionByName(after).isEmpty():
            removed, added = relabel(self.dirs, before, after)
            dirs = self.dirs.merge(removed, added)
            was, no = removed.select(*_ID, F.col("excluded").alias("was")), F.lit(False)
            both = added.select(*_ID, "excluded").join(was, _ID, "full_outer").withColumns({c: F.coalesce(c, no) for c in ("excluded", "was")})
            flips = materialize(both.where("excluded <> was").select("volume", F.col("frn").alias("parent_frn"), "excluded"), "flips")
        gone, fresh = (s.withColumn("folded", fold(F.col("name"))) for s in sides)
        gone = gone.select("volume_ord", "entry_id", *KEYS.values())
        own = F.col("hidden") | F.col("system")
        parents = fresh.select("volume", F.col("parent_frn").alias("frn")).distinct()
        above = dirs.rows.join(parents, _ID, "left_semi").select("volume", F.col("frn").alias("parent_frn"), "excluded")
        fresh = fresh.join(above, ["volume", "parent_frn"], "left").withColumn("is_excluded", own | F.coalesce("excluded", F.lit(False)))
        columns = self.orders.ranges("name").schema.names
        fresh = search.spell_entries(fresh).select(*columns)
        if flips is not None and not flips.isEmpty():
            # entries that the batch does not name, in directories that turned
            named = materialize(sides[0].unionByName(sides[1]).select("volume_ord", "entry_id").distinct(), "named")
            turned = self.catalogue.entries.join(flips, ["volume", "parent_frn"]).join(named, ["volume_ord", "entry_id"], "left_anti")
            turned = materialize(turned.withColumn("is_excluded", own | F.col("excluded")), "turned")
            gone = gone.unionByName(turned.select(*gone.columns))
            fresh = fresh.unionByName(turned.select(*columns))
        gone, fresh = materialize(gone, "gone"), materialize(fresh, "fresh")
        made = {sort: ranges.merge(gone, fresh) for sort, ranges in self.orders.made.items()}
        return StoredCatalogue._of(dirs, made, self.orders.part_rows, self.orders.under)
