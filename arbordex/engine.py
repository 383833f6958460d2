"""The engine: attached volumes, searches over them, live results."""

from __future__ import annotations

import itertools
import re
import time
from collections import OrderedDict
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import limits
from .errors import Cancelled, InvalidArgument, QuerySyntaxError, RescanRequired, StaleResult, TopologyError, VolumeUnavailable
from .metrics import Metrics
from .functions.fold import fold
from .operators import search, statistics, tree
from .operators.pages import Hits
from .operators.search import Catalogue
from .operators.stored import StoredCatalogue
from .plans.compiler import Options, Plan, compile_query
from .plans.implication import subsumes
from .sources.snapshots import Meta, SnapshotStore
from .streaming.apply import apply_batch
from .streaming.decisions import EventQueue, next_state
from .workspace import drop_now, materialize, owned


@dataclass
class Volume:
    """A volume's state, its rows, and the generations that tell stale results."""

    label: str
    ord: int
    state: str = "scanning"
    entries: DataFrame | None = None
    content: int = 0
    structural: int = 0
    stat: int = 0
    topology: int = 0
    dirty: bool = False
    tables: list[str] = field(default_factory=list)


@dataclass
class Result:
    """An ordered result, pinned to the generations and the stored catalogue that it was made from."""

    id: int
    plan: Plan
    found: Hits
    hits: int
    generations: dict[str, tuple[int, int, int, int]]
    stored: StoredCatalogue
    trace: dict = field(default_factory=dict)

    @property
    def rows(self) -> DataFrame:
        """All rows with pos; pages do not need them."""
        return self.found.positions()


class Engine:
    """Attach volumes, search them, page through results, and let changes in."""

    def __init__(self, spark: SparkSession):
        self.spark, self.volumes, self.events, self.metrics = spark, {}, EventQueue(), Metrics()
        self._results: OrderedDict[int, Result] = OrderedDict()
        self._ids = itertools.count(1)
        self._stored: StoredCatalogue | None = None
        self._folders: set[str] = set()
        self._emitted = 0
        self._searches = itertools.count(1)
        self._running: dict[str, int] = {}

    # volumes

    def attach(self, volumes: dict[str, DataFrame]) -> None:
        """Index the entries of each volume; a label that is attached already stays as it is.

        The whole request is checked before anything is done.
        """
        labels = [x.upper() for x in volumes]
        if not labels or len(set(labels)) != len(labels) or not all(re.fullmatch("[A-Z]:", x) for x in labels):
            raise InvalidArgument(f"labels {labels}")
        if len(self.volumes.keys() | set(labels)) > limits.MAX_VOLUMES:
            raise InvalidArgument("too many volumes")
        if any(v is None for v in volumes.values()):
            raise VolumeUnavailable(", ".join(k for k, v in volumes.items() if v is None))
        for label, entries in zip(labels, volumes.values(), strict=True):
            if label in self.volumes:
                continue
            volume = self.volumes[label] = Volume(label, len(self.volumes))
            self._emit("progress", label)
            try:
                with owned() as made:
                    self._install(volume, tree.resolve_parents(entries))
                drop_now(self.spark, made)
            except Exception:
                volume.state = next_state(volume.state, "volume_failed")
                self._emit("volume_failed", label)
                raise
            self._emit("volume_ready", label)
            volume.state = next_state(volume.state, "volume_ready")
        self._stored = None

    def _install(self, volume: Volume, entries: DataFrame) -> None:
        rows = entries.withColumn("volume", F.lit(volume.label)).withColumn("volume_ord", F.lit(volume.ord))
        with owned() as made:
            volume.entries = materialize(rows, "volume")
        drop_now(self.spark, volume.tables)
        volume.tables = made
        volume.dirty = True

    def replace(self, label: str, entries: DataFrame, structural: bool = False, kinds: tuple[str, ...] = ("content", "topology")) -> None:
        """Put a volume's next version in place; structural for a compaction or a new scan.

        kinds are the generations that move: content (names or rows), stat (sizes and times alone),
        topology (directories).
        """
        volume = self._volume(label)
        self._install(volume, entries)
        volume.structural += structural
        for kind in kinds:
            setattr(volume, kind, getattr(volume, kind) + 1)
        self._stored = None
        self._emit("index_changed", label)

    def apply(self, label: str, records: DataFrame, stats: DataFrame | None = None, links: DataFrame | None = None) -> dict[str, int]:
        """Apply a batch of change records to a volume; RescanRequired leaves the volume as it was and rescanning."""
        volume, looping = self._volume(label), False
        with owned() as made:
            # a stored catalogue finds loops below the directories that move, else all directories are closed
            done = apply_batch(volume.entries, records, stats, links, loops=self._stored is None)
            kinds = tuple(k for k, n in done.moved.items() if n)
            stored = self._stored
            if kinds and stored is not None:
                try:
                    stored = stored.changed(done.changes.withColumn("volume", F.lit(volume.label)).withColumn("volume_ord", F.lit(volume.ord)))
                except TopologyError:
                    looping = True
            if kinds and not looping and not done.rescan_required:
                self.replace(label, done.entries, kinds=kinds)
                self._stored = stored
                self._keep(stored)
        drop_now(self.spark, [t for t in made if t not in volume.tables])
        self.metrics.counters["batches"] += 1
        if done.rescan_required or looping:
            self.rescan(label)
            raise RescanRequired(f"{label} {'a directory below itself' if looping else done.stats}")
        return done.stats

    def rescan(self, label: str) -> None:
        """A volume that can no longer be followed: searches leave it out until rescanned()."""
        volume = self._volume(label)
        volume.state = next_state(volume.state, "rescan_started")
        self._stored = None
        self.metrics.counters["rescans"] += 1
        self._emit("rescan_started", label)

    def rescanned(self, label: str, entries: DataFrame) -> None:
        """The new scan's entries take the volume's place; results from before it are stale."""
        self.replace(label, tree.resolve_parents(entries), structural=True)
        volume = self._volume(label)
        volume.state = next_state(volume.state, "volume_ready")
        self._emit("volume_ready", label)

    def flush(self, stores: dict[str, SnapshotStore], journal_id: int = 0, next_usn: int = 0) -> dict[str, Meta]:
        """Save the volumes that changed since the last flush."""
        saved = {}
        for label, store in stores.items():
            volume = self._volume(label)
            if volume.dirty:
                saved[label] = store.save(volume.entries, journal_id, next_usn)
                volume.dirty = False
        return saved

    def _volume(self, label: str) -> Volume:
        if label not in self.volumes:
            raise VolumeUnavailable(label)
        return self.volumes[label]

    def _emit(self, kind: str, label: str) -> None:
        self._emitted += 1
        self.events.push((kind, label, self._emitted))
        self.metrics.counters["events_dropped"] = self.events.dropped

    def events_table(self) -> DataFrame:
        """The events that the queue still holds: number (from 1 over all events), kind, label."""
        return self.spark.createDataFrame([(n, kind, label) for kind, label, n in self.events.events], "number long, kind string, label string")

    def status(self) -> dict[str, str]:
        return {v.label: v.state for v in self.volumes.values()}

    def index_stats(self) -> DataFrame:
        return statistics.index_statistics(self._ready().withColumn("folded", fold(F.col("name"))))

    def metrics_snapshot(self) -> dict:
        return self.metrics.snapshot(self.spark)

    def _ready(self) -> DataFrame:
        ready = [v.entries for v in self.volumes.values() if v.state == "ready"]
        if not ready:
            raise VolumeUnavailable("no volume is ready")
        return reduce(DataFrame.unionByName, ready)

    def stored(self) -> StoredCatalogue:
        """All ready volumes together, in their orders: built after an attachment or a new scan, then kept by batches."""
        if self._stored is None:
            self._stored = StoredCatalogue.build(self._ready())
        self._keep(self._stored)
        return self._stored

    def catalogue(self) -> Catalogue:
        return self.stored().catalogue

    def _keep(self, *more: StoredCatalogue | None) -> None:
        """Delete the folders that neither the catalogue nor a live result reads any more."""
        held = {id(c): c for c in (self._stored, *more, *(r.stored for r in self._results.values())) if c is not None}
        live = set().union(*(c.folders() for c in held.values())) if held else set()
        dead = self._folders - live
        # a catalogue's folder goes as a whole where none of its parts is read
        top = lambda f: f.rsplit("/", 3)[0]
        kept = {top(f) for f in live}
        drop_now(self.spark, sorted({top(f) if top(f) not in kept else f for f in dead}))
        self._folders = live

    def _generations(self) -> dict[str, tuple[int, int, int, int]]:
        return {v.label: (v.content, v.structural, v.stat, v.topology) for v in self.volumes.values() if v.state == "ready"}

    # searches

    def search(self, text: str, options: Options = Options(), basis: Result | None = None, tag: str | None = None) -> Result:
        """The ordered result of a query.

        A live result whose query covers this one is filtered again instead of the catalogue. basis
        is the result on display: the trace tells whether nothing changed. tag names a line of searches,
        such as a window's: a later one cancels those before it, and so does cancel().
        """
        began = time.perf_counter()
        turn = self._take_turn(tag) if tag else 0
        try:
            plan = compile_query(text, options)
        except QuerySyntaxError:
            self.metrics.counters["syntax_errors"] += 1
            raise
        stored, now = self.stored(), self._generations()
        base = next((r for r in reversed(self._results.values()) if r.generations == now and subsumes(r.plan, plan)), None)
        own = f"{tag}-{turn}"
        if tag:
            self.spark.addTag(own)
        try:
            self._check_turn(tag, turn)
            found = stored.orders.hits(plan, within=base.found if base else None)
            hits = found.n
            self._check_turn(tag, turn)
        except Exception as e:
            if tag and self._running.get(tag) != turn:
                self.metrics.counters["cancelled"] += 1
                raise Cancelled(tag) from e
            self._emit("engine_error", "")
            raise
        finally:
            if tag:
                self.spark.removeTag(own)
        same = bool(basis and basis.generations == now and basis.hits == hits and search.unchanged(basis.rows, found.positions()))
        micros = int(1e6 * (time.perf_counter() - began))
        result = Result(next(self._ids), plan, found, hits, now, stored, {"hits": hits, "micros": micros, "refined": base is not None, "unchanged": same})
        self._results[result.id] = result
        while len(self._results) > limits.MAX_LIVE_RESULTS:
            self._results.popitem(last=False)
            self.metrics.counters["evicted_results"] += 1
        self._keep()
        self.metrics.query(text, hits, micros, base is not None, same)
        return result

    def _take_turn(self, tag: str) -> int:
        """The number of a new search under tag; the one before it is interrupted."""
        turn = next(self._searches)
        before, self._running[tag] = self._running.get(tag), turn
        if before:
            self.spark.interruptTag(f"{tag}-{before}")
        return turn

    def _check_turn(self, tag: str | None, turn: int) -> None:
        if tag and self._running.get(tag) != turn:
            raise Cancelled(tag)

    def cancel(self, tag: str) -> None:
        """Cancel the searches under tag, also those that have not started their work."""
        self._take_turn(tag)

    def page(self, result_id: int, offset: int, n: int = limits.MAX_PAGE_ROWS) -> DataFrame:
        """Rows of a live result; StaleResult if it was released, rebuilt under, or lost a row of the page."""
        result = self._results.get(result_id)
        if result is None:
            self.metrics.counters["stale_results"] += 1
            raise StaleResult(str(result_id))
        self._results.move_to_end(result_id)
        now = self._generations()
        if any(now.get(k, (0, -1, 0, 0))[1] != g[1] for k, g in result.generations.items()):
            raise StaleResult("rebuilt")
        if now != result.generations:
            rows = result.found.numbered(offset, min(n, limits.MAX_PAGE_ROWS))
            alive = self.catalogue().entries.select("volume_ord", "entry_id")
            if not rows.join(alive, ["volume_ord", "entry_id"], "left_anti").isEmpty():
                self.metrics.counters["stale_results"] += 1
                raise StaleResult("a row is gone")
        return replace(result.found, paths=self.catalogue().paths).page(offset, n).orderBy("pos") if now == result.generations else search.projected(rows, self.catalogue().paths).orderBy("pos")

    def free(self, result_id: int) -> None:
        """Forget a result; what it alone reads is deleted."""
        if self._results.pop(result_id, None):
            self._keep()
