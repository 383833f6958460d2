"""Following a binary change journal: open at a cursor, read buffers, apply them, or ask for a new scan.

A read of the journal is a row (buffer_id long, payload binary, condition string): condition is null
for a buffer, one of GONE where the journal no longer has what was asked for, anything else for a read
that failed. Buffers are decoded in tasks; a batch that holds one malformed buffer, or one read of a
journal that is gone, is thrown away whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RescanRequired, VolumeUnavailable
from ..sources import journal, journal_source
from ..sources.metadata import MetadataTables
from ..sources.snapshots import Meta, SnapshotStore
from ..workspace import drop_now, materialize, owned
from .apply import apply_to_store
from .decisions import JournalView, restore_decision, tail_decisions

READS = "buffer_id long, payload binary, condition string"
#: the journal was deleted, is being deleted, is not active, or has lost the records at the cursor
GONE = ("journal deleted", "delete in progress", "not active", "entry deleted")


@dataclass(frozen=True)
class Opened:
    """What to do first, and the number of the first record to follow afterwards; None where the journal is unknown."""

    decision: str
    cursor: int | None


def open_at(meta: Meta | None, view: JournalView | None) -> Opened:
    """A valid checkpoint goes on at its cursor; a scan follows from the journal's end as it was before the scan."""
    decision = restore_decision(meta, view)
    if decision == "restore":
        return Opened(decision, meta.next_usn)
    return Opened(decision, view.next_usn if view else None)


def judged(reads: DataFrame) -> DataFrame:
    """Decoded records of the reads with decision: apply, rescan or fail. A read without records is one row with null usn."""
    rows = journal.records(reads.where("condition is null")).withColumn("condition", F.lit(None).cast("string"))
    rest = reads.where("condition is not null").select("buffer_id", "condition")
    rows = rows.unionByName(rest, allowMissingColumns=True)
    gone = F.col("condition").isin(*GONE)
    return rows.withColumn("decision", tail_decisions(F.col("truncated"), gone, F.col("condition").isNotNull() & ~gone))


def apply_reads(store: SnapshotStore, reads: DataFrame, stats: DataFrame | None, links: DataFrame | None, batch_id: int, writer: str = "", lookups: MetadataTables | None = None) -> Meta:
    """Apply a micro-batch of reads from the store's cursor on; records before it are in the store already.

    The cursor moves to the furthest cursor of the buffers, also where they hold no records.
    """
    return apply_judged(store, judged(reads), stats, links, batch_id, writer, lookups)


def apply_judged(store: SnapshotStore, rows: DataFrame, stats: DataFrame | None, links: DataFrame | None, batch_id: int, writer: str = "", lookups: MetadataTables | None = None) -> Meta:
    """apply_reads for records that are decoded and have a decision."""
    meta = store.latest()
    if meta is None:
        raise RescanRequired("scan: first run")
    if meta.last_batch(writer) >= batch_id:
        return meta
    with owned() as made:
        rows = materialize(rows, "reads")
        said = {r["decision"]: r for r in rows.groupBy("decision").agg(F.max("next_usn").alias("cursor"), F.max("condition").alias("condition")).collect()}
        if "fail" not in said and "rescan" not in said and "apply" in said:
            cursor = max(said["apply"]["cursor"], meta.next_usn)
            fresh = rows.where(F.col("usn") >= meta.next_usn).select("usn", "frn", "parent_frn", "reason", "attributes", "name")
            done = apply_to_store(store, fresh, stats, links, batch_id, cursor, writer, lookups)
            if done.last_batch(writer) < batch_id and cursor > meta.next_usn:  # nothing to apply, but the journal went on
                done = store.save(store.read(meta.version, []), meta.journal_id, cursor, batch_id, [], done, writer, topology=False)
            meta = done
    drop_now(store.spark, made)
    if "fail" in said:
        raise VolumeUnavailable(f"journal: {said['fail']['condition']}")
    if "rescan" in said:
        raise RescanRequired(said["rescan"]["condition"] or "malformed buffer")
    return meta


def follow(reads: DataFrame, store: SnapshotStore, checkpoint: str, view: JournalView | None, stats: DataFrame | None = None, links: DataFrame | None = None, writer: str = "", lookups: MetadataTables | None = None, **trigger):
    """A streaming query from a stream of reads (READS) into the store.

    RescanRequired at once if the store's checkpoint does not suit the journal; the query ends with that
    error, or with VolumeUnavailable, when a batch says so, and the store stays at the batch before.
    """
    opened = open_at(store.latest(), view)
    if opened.decision != "restore":
        raise RescanRequired(opened.decision)

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_reads(store, batch, stats, links, batch_id, writer, lookups)

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow_journal(store: SnapshotStore, path: str, checkpoint: str, stats: DataFrame | None = None, links: DataFrame | None = None, writer: str = "", lookups: MetadataTables | None = None, **trigger):
    """A streaming query from a journal's folder (sources/journal_source.py) into the store, from the store's cursor on.

    A restart goes on at the checkpoint's cursor, or without one at the store's. RescanRequired at once if
    the store does not suit the journal, and from ended() when the journal is gone or a buffer malformed.
    """
    spark, now = store.spark, journal_source.status(path)
    opened = open_at(store.latest(), JournalView(now["journal_id"], now["first_usn"], now["next_usn"]) if now else None)
    if opened.decision != "restore":
        raise RescanRequired(opened.decision)
    spark.dataSource.register(journal_source.JournalSource)
    options = {"path": path, "journalId": now["journal_id"], "startUsn": opened.cursor}
    rows = spark.readStream.format(journal_source.NAME).options(**options).load().withColumn("condition", F.lit(None).cast("string"))
    rows = rows.withColumn("decision", tail_decisions(F.col("truncated"), F.lit(False), F.lit(False)))

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_judged(store, batch, stats, links, batch_id, writer, lookups)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ended(query, timeout: float | None = None) -> bool | None:
    """query.awaitTermination; a source whose journal is gone, or a batch that needs a new scan, is RescanRequired here."""
    try:
        return query.awaitTermination(timeout)
    except StreamingQueryException as e:
        # the error came from another process, as text
        found = re.search(r"(?:JournalGone|RescanRequired): (?:journal gone: )?([^\n]*)", str(e))
        if found:
            raise RescanRequired(found[1].strip()) from e
        raise
