"""Applying batches of change records to a catalogue.

A batch is reduced to one row per object: the union of its reasons, its last record, its first old
name. Metadata and complete link sets are joined to it, an action is decided for each object, and
the entries are rewritten by one join on the object. Directories keep their entry when they move, so
everything below moves with them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CommitConflict, RescanRequired, SnapshotInvalid, TopologyError
from ..functions.scalars import REASONS, has_attribute, record
from ..operators import tree
from ..operators.ranks import number
from ..operators.statistics import live
from ..sources.metadata import LINKS, STATS, MetadataTables
from ..sources.snapshots import COLUMNS, WAITING, Meta, SnapshotStore, bucket_of, names
from ..workspace import drop_now, materialize, owned

_LINK_REASONS = ("FILE_CREATE", "RENAME_NEW_NAME", "HARD_LINK_CHANGE")
_STAT_REASONS = ("DATA_OVERWRITE", "DATA_EXTEND", "DATA_TRUNCATION", "BASIC_INFO_CHANGE")
TALLY = ("created_or_renamed", "deleted", "stat_updated", "ignored", "stat_failures", "index_rejections", "hard_link_refresh_failures")

MOVED = ("content", "stat", "topology")
_CONTENT, _STAT = ("parent_frn", "name", "hidden", "system", "reparse", "tombstone"), ("size", "mtime_secs")


@dataclass(frozen=True)
class Applied:
    """entries after the batch, one row of figures, and whether the volume must be scanned anew.

    changes: the live rows that the batch changed, removed or made, as they were (side "before") and as
    they are ("after"); moved: how many rows changed in what searches see by name and visibility (content),
    in sizes and times (stat), and how many of the former are directories (topology). late: objects (frn)
    whose look-ups failed, with the kind (stat, links) and their last record (last_usn, last).
    """

    entries: DataFrame
    stats: dict[str, int]
    rescan_required: bool
    changes: DataFrame | None = None
    moved: dict[str, int] = field(default_factory=lambda: dict.fromkeys(MOVED, 0))
    late: DataFrame | None = None


def _large(rows: DataFrame) -> DataFrame:
    """rows that go with the batch or the entries: no join sends them through the driver.

    Spark guesses the size of a few columns from the whole file's, and would broadcast millions of rows.
    """
    return rows.hint("merge")


def _any(reasons: Column, *wanted: str) -> Column:
    mask = 0
    for name in wanted:
        mask |= REASONS[name]
    return reasons.bitwiseAND(F.lit(mask).cast("long")) != 0


def reduce_records(records: DataFrame) -> DataFrame:
    """One row per frn: reasons, last (parent_frn, name, attributes), old (parent_frn, name), first_usn, last_usn."""
    last = F.max_by(F.struct("parent_frn", "name", "attributes"), "usn")
    old = F.min_by(F.when(_any(F.col("reason"), "RENAME_OLD_NAME"), F.struct("parent_frn", "name")), F.when(_any(F.col("reason"), "RENAME_OLD_NAME"), F.col("usn")))
    return records.groupBy("frn").agg(F.bit_or("reason").alias("reasons"), last.alias("last"), old.alias("old"), F.min("usn").alias("first_usn"), F.max("usn").alias("last_usn"))


def decide(entries: DataFrame, records: DataFrame, stats: DataFrame, links: DataFrame) -> DataFrame:
    """The reduced batch with what is known of each object, its action, and whether it fails the whole batch.

    stat_state and link_state tell what the look-ups gave: present, gone (links only) or failed.
    """
    now = live(entries)
    objects = now.groupBy("frn").agg(F.count(F.lit(1)).alias("n_links"), F.bool_or("is_dir").alias("was_dir"), F.min_by(F.struct("size", "mtime_secs"), "entry_id").alias("carried"), F.collect_set(F.struct("parent_frn", "name")).alias("link_set"))
    sets = links.groupBy("frn").agg(F.max("state").alias("state"), F.collect_set(F.when(F.col("state") == "present", F.struct("parent_frn", "name"))).alias("desired"))
    batch = reduce_records(records)
    # record numbers meet as keys alone, so that the rows stay where their object is; a semi join would go below the distinct
    touched = records.select("frn", record(F.col("frn")).alias("record")).distinct()
    used = touched.join(_large(now.select(record(F.col("frn")).alias("record")).distinct()), "record").select("frn", F.lit(True).alias("record_used"))
    rows = batch.join(_large(objects), "frn", "left").join(_large(sets), "frn", "left").join(_large(stats.withColumn("fetched", F.struct("size", "mtime_secs")).select("frn", "fetched")), "frn", "left").join(_large(used), "frn", "left")
    r, is_dir = F.col("reasons"), has_attribute(F.col("last.attributes"), "DIRECTORY")
    rows = rows.withColumn("is_dir", is_dir).withColumn("n_links", F.coalesce("n_links", F.lit(0))).withColumn("was_dir", F.coalesce("was_dir", F.lit(False)))
    linking = _any(r, *_LINK_REASONS) & ~is_dir
    rows = rows.withColumn("stat_state", F.when(F.col("fetched").isNotNull(), "present").otherwise("failed"))
    rows = rows.withColumn("link_state", F.when((F.col("state") == "present") & (F.size("desired") > 0), "present").when(F.col("state") == "gone", "gone").otherwise("failed"))
    has_links, gone = F.col("link_state") == "present", F.col("link_state") == "gone"
    old_stands = F.coalesce(F.array_contains("link_set", F.col("old")), F.lit(False))
    unsure = _any(r, "RENAME_NEW_NAME") & (F.col("n_links") > 1) & ~old_stands
    fails = F.when(is_dir, _any(r, "HARD_LINK_CHANGE")).otherwise(linking & ~has_links & ~gone & (_any(r, "HARD_LINK_CHANGE") | unsure))
    naming = _any(r, "FILE_CREATE", "RENAME_NEW_NAME")
    action = (
        F.when(linking & has_links, "links")
        .when(linking & gone | _any(r, "FILE_DELETE"), "delete")
        .when(naming & F.col("was_dir") & is_dir, "move_dir")
        .when(naming & (F.col("n_links") == 0) & ~_any(r, "FILE_CREATE") & F.col("record_used").isNotNull(), "ignore")
        .when(naming, "upsert")
        .when(_any(r, *_STAT_REASONS) & (F.col("n_links") > 0), "stat")
        .otherwise("ignore")
    )
    return rows.withColumn("fails", fails).withColumn("action", action).withColumn("old_stands", old_stands)


def _wanted_links(rows: DataFrame) -> DataFrame:
    """The links that should exist afterwards, of objects whose links or names change."""
    one = F.array(F.struct(F.col("last.parent_frn").alias("parent_frn"), F.col("last.name").alias("name")))
    target = F.when(F.col("action") == "links", F.col("desired")).when(F.col("action").isin("upsert", "move_dir"), one)
    return rows.withColumn("wanted", target).where("wanted is not null").select("frn", "is_dir", F.explode("wanted").alias("link")).select("frn", "is_dir", "link.*")


def _rejected(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Objects whose new parent is no live directory, neither before nor made by the batch."""
    gone = rows.where("action = 'delete'").select("frn")
    before = live(entries).where("is_dir").select("frn").join(_large(gone), "frn", "left_anti")
    wanted = _wanted_links(rows)
    bad = None
    while True:
        fresh = wanted.where("is_dir").select("frn")
        good = before.unionByName(fresh if bad is None else fresh.join(bad, "frn", "left_anti")).distinct().withColumnRenamed("frn", "parent_frn")
        found = wanted.join(good, "parent_frn", "left_anti").select("frn").distinct()
        found = materialize(found, "rejected")
        n = found.count()
        if bad is not None and n == bad.count() or n == 0:
            return found
        bad = found


def apply_batch(entries: DataFrame, records: DataFrame, stats: DataFrame | None = None, links: DataFrame | None = None, last_id: int | None = None, loops: bool = True, hold: bool = False) -> Applied:
    """entries (the snapshot columns) after one batch of records (usn, frn, parent_frn, reason, attributes, name).

    stats and links hold what metadata look-ups gave. An object whose link set is needed and missing
    rejects the whole batch; one whose parent is no directory is left out, and both ask for a new scan.
    entries may be a part of the catalogue that holds all rows of the records concerned and all
    directories; last_id is then the largest entry_id of the whole. loops: whether to look for directories
    that come to stand below themselves; a stored catalogue's own step finds them cheaper. hold: files whose link
    set is missing are left as they are instead, for the batch's caller to bring them again.
    """
    spark = entries.sparkSession
    stats = stats if stats is not None else spark.createDataFrame([], STATS)
    links = links if links is not None else spark.createDataFrame([], LINKS)
    entries = entries.select(*names())
    rows = materialize(decide(entries, records, stats, links), "decided")
    tally = dict.fromkeys(TALLY, 0)
    failing, held = rows.where("fails").agg(F.count(F.lit(1)), F.count_if(~F.col("is_dir"))).first()
    held = held if hold else 0
    failing -= held
    if failing:
        tally |= {"hard_link_refresh_failures": failing, "ignored": failing}
        return Applied(entries, tally, True)
    late = rows.where("fails or fetched is null and action in ('stat', 'upsert', 'links')").select("frn", F.when(F.col("fails"), "links").otherwise("stat").alias("kind"), "last_usn", "last")
    if held:
        rows = rows.where("not fails")
    bad = _rejected(entries, rows)
    n_bad = bad.count()
    rows = rows.join(_large(bad), "frn", "left_anti")

    attributes = F.col("last.attributes")
    facts = F.coalesce("fetched", "carried", F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_secs")))
    change = rows.select(
        F.col("frn").alias("c_frn"), "action", F.col("first_usn").alias("c_first"), "fetched", "old", "old_stands", "n_links", "was_dir", "last",
        F.when(F.col("action") == "links", F.col("desired")).alias("desired"), F.col("is_dir").alias("c_dir"), facts.alias("facts"), "reasons",
        has_attribute(attributes, "HIDDEN").alias("c_hidden"), has_attribute(attributes, "SYSTEM").alias("c_system"), has_attribute(attributes, "REPARSE_POINT").alias("c_reparse"),
    )
    # objects whose record number goes to another one that the batch makes
    made = change.where("action in ('links', 'upsert')").select(record(F.col("c_frn")).alias("record"), F.col("c_frn").alias("m_frn"))
    keys = live(entries).select("frn", record(F.col("frn")).alias("record"))
    replaced_by = keys.join(_large(made), "record").where("frn <> m_frn").select(F.col("frn").alias("r_frn")).distinct()
    joined = entries.join(_large(change), F.col("frn") == F.col("c_frn"), "left").join(_large(replaced_by), F.col("frn") == F.col("r_frn"), "left")
    link = F.struct("parent_frn", "name")
    new_link = F.struct(F.col("last.parent_frn").alias("parent_frn"), F.col("last.name").alias("name"))
    a = F.col("action")
    renamed = _any(F.col("reasons"), "RENAME_NEW_NAME") & ~F.col("c_dir")
    replaced = (a == "upsert") & (link != new_link) & (F.col("c_dir") | renamed & F.when(F.col("old_stands"), link == F.col("old")).otherwise(F.col("n_links") == 1))
    dies = (a == "delete") | ((a == "links") & ~F.array_contains("desired", link)) | replaced | F.col("r_frn").isNotNull()
    dies = ~F.col("tombstone") & F.coalesce(dies, F.lit(False))
    acts = ~F.col("tombstone") & ~dies & a.isin("links", "upsert", "move_dir", "stat")
    restat = acts & (a != "move_dir") & F.when(a == "stat", F.col("fetched").isNotNull()).otherwise(F.lit(True))
    moves = acts & (a == "move_dir")

    def when(test: Column, value: Column, column: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), value).otherwise(F.col(column)).alias(column)

    # evaluated on the columns before the change, in one projection
    then = {
        "parent_frn": when(moves, F.col("last.parent_frn"), "parent_frn"), "name": when(moves, F.col("last.name"), "name"),
        "hidden": when(acts, F.col("c_hidden"), "hidden"), "system": when(acts, F.col("c_system"), "system"), "reparse": when(acts, F.col("c_reparse"), "reparse"),
        "tombstone": (F.col("tombstone") | dies).alias("tombstone"), "size": when(restat, F.col("facts.size"), "size"), "mtime_secs": when(restat, F.col("facts.mtime_secs"), "mtime_secs"),
    }
    content, stat = (reduce(Column.__or__, [~then[c].eqNullSafe(F.col(c)) for c in cs]) for cs in (_CONTENT, _STAT))
    was = F.when(content | stat, F.struct(*[F.col(c) for c in (*_CONTENT, *_STAT)])).alias("was")
    kept = joined.select(*[then.get(c, F.col(c)) for c in names()], (dies & F.coalesce(a.isin("delete", "links"), F.lit(False))).alias("died"), content.alias("content"), stat.alias("stat"), was)
    kept = materialize(kept, "kept")
    standing = live(kept).select("frn", "parent_frn", "name")
    new = _wanted_links(rows.where("action in ('links', 'upsert')")).drop("is_dir").join(_large(standing), ["frn", "parent_frn", "name"], "left_anti")
    new = new.join(_large(change), F.col("frn") == F.col("c_frn"))
    highest = F.max("entry_id") if last_id is None else F.greatest(F.max("entry_id"), F.lit(last_id))
    ends = kept.agg(highest.alias("last_id"), F.first("volume").alias("volume"), F.first("volume_ord").alias("volume_ord"))
    new = new.select("frn", "parent_frn", "name", F.col("c_dir").alias("is_dir"), F.col("c_hidden").alias("hidden"), F.col("c_system").alias("system"), F.col("c_reparse").alias("reparse"), F.col("facts.size").alias("size"), F.col("facts.mtime_secs").alias("mtime_secs"), F.col("c_first").alias("new_first"))
    # new links are numbered in journal order; one row is broadcast
    new = number(new, [F.col(c) for c in ("new_first", "frn", "parent_frn", "name")], "place")
    fresh = new.withColumn("__k", F.lit(1)).join(F.broadcast(ends.withColumn("__k", F.lit(1))), "__k").withColumn("entry_id", F.coalesce("last_id", F.lit(0)) + F.col("place") + 1).withColumn("tombstone", F.lit(False))
    fresh = materialize(fresh.select(*names()), "fresh")
    after = kept.select(*names()).unionByName(fresh)
    changed = kept.where("was is not null")
    before = changed.select(*[F.col(f"was.{c}").alias(c) if c in (*_CONTENT, *_STAT) else F.col(c) for c in names()])
    changes = live(before).withColumn("side", F.lit("before")).unionByName(live(changed.select(*names()).unionByName(fresh)).withColumn("side", F.lit("after")))
    told = changed.select("content", "stat", "is_dir", "died").unionByName(fresh.select(F.lit(True).alias("content"), F.lit(False).alias("stat"), "is_dir", F.lit(False).alias("died")))
    *moved, died = told.agg(F.count_if("content"), F.count_if("stat"), F.count_if(F.col("content") & F.col("is_dir")), F.count_if("died")).first()

    counts = rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fetched").isNull()).alias("blind"), F.count_if(F.col("n_links") == 0).alias("absent")).collect()
    by = {r["action"]: r for r in counts}
    linked = fresh.join(_large(change.where("action = 'links'").select(F.col("c_frn").alias("frn"))), "frn", "left_semi").count() if "links" in by else 0
    get = lambda k, f: by[k][f] if k in by else 0
    tally["created_or_renamed"] = get("upsert", "n") + get("move_dir", "n") + linked
    tally["deleted"] = died
    tally["stat_updated"] = get("stat", "n") - get("stat", "blind")
    tally["stat_failures"] = get("stat", "blind") + get("upsert", "blind") + get("links", "blind")
    tally["ignored"] = get("ignore", "n") + get("delete", "absent") + n_bad
    tally["index_rejections"], tally["hard_link_refresh_failures"] = n_bad, held
    looping = False
    if "move_dir" in by and loops:
        try:
            tree.close_directories(after, strict=True)
        except TopologyError:
            looping = True
    if looping:  # a directory below itself: nothing of the batch is kept
        tally = dict.fromkeys(TALLY, 0) | {"index_rejections": n_bad + 1, "ignored": n_bad + 1}
        return Applied(entries, tally, True)
    return Applied(after, tally, n_bad > 0, changes, dict(zip(MOVED, moved, strict=True)), late)


def compact(entries: DataFrame) -> DataFrame:
    """Live rows renumbered from 0 in their order per volume; rows whose parent is gone hang at the root."""
    rows = tree.resolve_or_root(live(entries))
    numbered = number(rows, [F.col("volume_ord"), F.col("entry_id")])
    firsts = numbered.groupBy("volume").agg(F.min("pos").alias("__first"))
    done = numbered.join(F.broadcast(firsts), "volume")  # one row per volume
    return done.withColumn("entry_id", F.col("pos") - F.col("__first")).select(*names())


def compaction_due(n_rows: int, tombstones: int, dead_name_bytes: int = 0, appended_names: int = 0, least_rows: int = 100_000) -> bool:
    sparse = n_rows >= max(1, least_rows) and tombstones > 0.125 * n_rows
    return sparse or dead_name_bytes > 32 << 20 or appended_names > (n_rows - tombstones) // 4


def swept(entries: DataFrame, store: SnapshotStore, buckets: int) -> DataFrame:
    """entries without the tombstones of buckets of which too many rows are such, by the store's dead_share; ids stay."""
    if store.dead_share is None:
        return entries
    at = bucket_of(F.col("frn"), buckets)
    figures = entries.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("tombstone").alias("dead"))
    due = figures.where((F.col("dead") > store.dead_share * F.col("n")) & (F.col("n") * buckets >= store.least_rows))
    due = [r["bucket"] for r in due.collect()]  # at most one for each bucket
    return entries.where(~(F.col("tombstone") & at.isin(due))) if due else entries


def _part(store: SnapshotStore, meta: Meta, records: DataFrame, links: DataFrame | None, touched: list[int]) -> DataFrame:
    """What a batch needs of a version: the buckets of its objects, and of the others the directories that it names as parents.

    Only where a directory that stands may move are all directories needed, to see whether it comes below itself.
    """
    own = store.read(meta.version, touched)
    if len(set(touched)) == meta.buckets:
        return own
    others = store.read(meta.version, [b for b in range(meta.buckets) if b not in set(touched)]).where("is_dir")
    naming = _any(F.col("reason"), "FILE_CREATE", "RENAME_NEW_NAME") & has_attribute(F.col("attributes"), "DIRECTORY")
    moving = live(own).where("is_dir").join(records.where(naming).select("frn"), "frn", "left_semi")
    if not moving.isEmpty():
        return own.unionByName(others)
    named = records.select("parent_frn")
    if links is not None:
        wanted = links.join(_large(records.select("frn").distinct()), "frn", "left_semi")
        named = named.unionByName(wanted.select("parent_frn"))
    return own.unionByName(materialize(others.join(named.select(F.col("parent_frn").alias("frn")).distinct(), "frn", "left_semi").select(*names()), "parents"))


#: how often a batch is made again behind another writer's version
TRIES = 8


#: for how many batches a link set may be missing before the volume is to be scanned anew
PATIENCE = 1000
#: a writer's waiting records lie in at most so many folders
SHELVES = 16
_RECORD = "usn", "frn", "parent_frn", "reason", "attributes", "name"


def _asked(waiting: DataFrame | None, records: DataFrame, lookups: MetadataTables) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(waiting, stats, links), written: the records that wait with due, whether they go into this batch, and what is known of all objects.

    Due is what a look-up knows by now, and what the batch itself has an object of. Nothing waits where waiting is None.
    """
    keys = records.select("frn")
    stats, links = (materialize(k, "known") for k in lookups.look_up(keys if waiting is None else keys.unionByName(waiting.select("frn"))))
    if waiting is None:
        return None, stats, links
    known = stats.select("frn", F.lit("stat").alias("kind")).unionByName(links.where("state <> 'failed'").select("frn", F.lit("links").alias("kind")).distinct())
    met = records.select(record(F.col("frn")).alias("record")).distinct().withColumn("met", F.lit(True))
    rows = waiting.join(_large(known.withColumn("known", F.lit(True))), ["frn", "kind"], "left").withColumn("record", record(F.col("frn"))).join(_large(met), "record", "left")
    due = F.coalesce("known", F.lit(False)) | F.coalesce("met", F.lit(False))
    return materialize(rows.select(*_RECORD, "kind", "since", due.alias("due")), "asked"), stats, links


def _left_over(done: Applied, records: DataFrame, due: DataFrame | None, batch_id: int) -> DataFrame:
    """What waits after a batch: one record for a size, all of its records for an object whose links are missing.

    Objects that the batch took away wait no longer. records are the batch's with those that were due (None: none were).
    """
    standing = live(done.entries).select("frn").distinct().withColumn("stands", F.lit(True))
    late = done.late.join(_large(standing), "frn", "left").where("stands or kind = 'links'")
    since = F.lit(batch_id).cast("long")
    if due is not None:
        late = late.join(_large(due.groupBy("frn").agg(F.min("since").alias("since"))), "frn", "left")
        since = F.coalesce("since", since)
    late = late.select("frn", "kind", since.alias("since"), "last_usn", "last")
    sizes = late.where("kind = 'stat'").select(F.col("last_usn").alias("usn"), "frn", "last.parent_frn", F.lit(REASONS["BASIC_INFO_CHANGE"]).cast("long").alias("reason"), "last.attributes", "last.name", "kind", "since")
    if not done.stats["hard_link_refresh_failures"]:
        return sizes
    return sizes.unionByName(records.join(_large(late.where("kind = 'links'").select("frn", "kind", "since")), "frn").select(*_RECORD, "kind", "since"))


def _shelve(store: SnapshotStore, meta: Meta, writer: str, rest: DataFrame, n_due: int, fresh: DataFrame) -> tuple[list[str], DataFrame | None]:
    """Which folders of waiting records stay and what is written: new rows alone, or all where some are done or folders are many."""
    folders = meta.waiting.get(writer, [])
    if n_due or len(folders) >= SHELVES:
        fresh = fresh.unionByName(rest)
        folders = []
    return folders, None if fresh.isEmpty() else fresh


def apply_to_store(store: SnapshotStore, records: DataFrame, stats: DataFrame | None, links: DataFrame | None, batch_id: int | None, next_usn: int | None = None, writer: str = "", lookups: MetadataTables | None = None, patience: int = PATIENCE) -> Meta:
    """Apply a micro-batch to the store's last version; a batch of this writer that is already in it changes nothing.

    The buckets of the batch's objects are read and written whole, of the others only directories
    are read. next_usn is where the journal goes on; without it, behind the last record. Where another
    writer was faster, the batch is made again from its version. Writers of one store name themselves.

    With lookups, which take the place of stats and links, nothing that a look-up did not give is lost: the
    object's record waits with the version that the batch makes, and comes again in the first batch for which
    the look-up is there. A file whose link set is needed stays as it was until then, while the batch's other
    objects go on; RescanRequired only if it waits for more than patience batches.
    """
    for left in reversed(range(TRIES)):
        meta = store.latest()
        if batch_id is not None and meta.last_batch(writer) >= batch_id:
            return meta
        number_ = meta.last_batch(writer) if batch_id is None else batch_id
        rejected, waiting = None, None
        with owned() as made:
            try:
                batch, known = records, (stats, links)
                if lookups is not None:
                    asked, *known = _asked(store.waiting(meta, writer) if meta.waiting.get(writer) else None, records, lookups)
                    batch, due, n_due, rest = records.select(*_RECORD), None, 0, store.spark.createDataFrame([], WAITING)
                    if asked is not None:
                        due, rest = asked.where("due").drop("due"), asked.where("not due").drop("due")
                        n_due, batch = due.count(), batch.unionByName(due.select(*_RECORD))
                    batch = materialize(batch, "batch")
                # at most a row for each bucket
                touched = [r[0] for r in batch.select(bucket_of(F.col("frn"), meta.buckets)).distinct().collect()]
                if not touched:
                    return meta
                done = apply_batch(_part(store, meta, batch, known[1], touched), batch, *known, meta.last_id, hold=lookups is not None)
                if lookups is not None and done.late is not None:
                    fresh = materialize(_left_over(done, batch, due if n_due else None, number_), "late")
                    overdue = fresh.unionByName(rest).where((F.col("kind") == "links") & (F.col("since") + patience < number_))
                    if not overdue.isEmpty():
                        rejected = {"hard_link_refresh_failures": overdue.select("frn").distinct().count()}
                    waiting = _shelve(store, meta, writer, rest, n_due, fresh)
                if done.rescan_required:
                    rejected = done.stats
                if rejected is None:
                    cursor = next_usn
                    if cursor is None:
                        cursor = batch.agg(F.max("usn")).first()[0] + 1
                        cursor = max(cursor, meta.next_usn) if lookups is not None else cursor
                    return store.save(swept(done.entries, store, meta.buckets), meta.journal_id, cursor, number_, touched, meta, writer, done.moved["topology"] > 0, waiting)
            except (CommitConflict, SnapshotInvalid):
                if not left or store.latest() == meta:
                    raise
            finally:
                drop_now(store.spark, made)
        if rejected is not None:
            raise RescanRequired(f"batch {number_} needs a new scan: {rejected}")
    raise CommitConflict(f"batch {batch_id} was overtaken {TRIES} times")


def heal(store: SnapshotStore, lookups: MetadataTables, writer: str = "", patience: int = PATIENCE) -> Meta:
    """Apply what waits and is known by now, without a batch of the journal."""
    none = store.spark.createDataFrame([], ", ".join(c for c in WAITING.split(", ")[: len(_RECORD)]))
    return apply_to_store(store, none, None, None, None, store.latest().next_usn, writer, lookups, patience)


def start(records: DataFrame, store: SnapshotStore, checkpoint: str, stats: DataFrame | None = None, links: DataFrame | None = None, writer: str = "", lookups: MetadataTables | None = None, **trigger):
    """A streaming query that keeps the store current; the stream's checkpoint and the store's batch number make replays harmless.

    Streams into one store need a writer's name each. lookups are read anew for each batch (see apply_to_store).
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with owned() as made:
            apply_to_store(store, materialize(batch, "batch"), stats, links, batch_id, writer=writer, lookups=lookups)
        drop_now(store.spark, made)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def empty_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)
