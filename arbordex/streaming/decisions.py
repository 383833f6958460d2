"""What a volume does next: restore or scan, apply or scan again; its state, its events."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import limits
from ..sources.snapshots import FORMAT, Meta

#: Fixed state and event names.
STATES = ("scanning", "ready", "rescanning", "failed")
EVENTS = ("progress", "volume_ready", "index_changed", "rescan_started", "volume_failed", "engine_error")


@dataclass(frozen=True)
class JournalView:
    """What a journal says of itself: its records have numbers from first_usn up to, not with, next_usn.

    None in its place means that it could not be asked.
    """

    journal_id: int
    first_usn: int
    next_usn: int = 0


def restore_decisions(checkpoint: Column, journal: Column) -> Column:
    """restore, or the reason of a full scan, for structs checkpoint (format, journal_id, next_usn) and journal (journal_id, first_usn)."""
    stale = (journal["journal_id"] != checkpoint["journal_id"]) | (checkpoint["next_usn"] < journal["first_usn"])
    return (
        F.when(checkpoint.isNull(), "scan: first run")
        .when(~checkpoint["format"].eqNullSafe(F.lit(FORMAT)), "scan: snapshot unusable")
        .when(journal.isNull(), "scan: journal query failed")
        .when(F.coalesce(stale, F.lit(True)), "scan: checkpoint stale")
        .otherwise("restore")
    )


def restore_decision(meta: Meta | None, journal: JournalView | None) -> str:
    """The decision for one volume, on the driver."""
    if meta is None:
        return "scan: first run"
    if meta.format != FORMAT:
        return "scan: snapshot unusable"
    if journal is None:
        return "scan: journal query failed"
    if journal.journal_id != meta.journal_id or meta.next_usn < journal.first_usn:
        return "scan: checkpoint stale"
    return "restore"


def tail_decisions(truncated: Column, gone: Column, failed: Column) -> Column:
    """What a read of the journal asks for: apply, rescan or fail."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(failed), "fail").when(yes(gone) | yes(truncated), "rescan").otherwise("apply")


def next_state(state: str, event: str) -> str:
    moves = {
        ("scanning", "volume_ready"): "ready",
        ("ready", "rescan_started"): "rescanning",
        ("rescanning", "volume_ready"): "ready",
    }
    return "failed" if event == "volume_failed" else moves.get((state, event), state)


class Debounce:
    """At most one event per interval, at its leading edge."""

    def __init__(self, interval: float = 0.2):
        self.interval, self.last = interval, None

    def passes(self, now: float) -> bool:
        if self.last is not None and now - self.last < self.interval:
            return False
        self.last = now
        return True


@dataclass
class EventQueue:
    """The latest events; older ones are dropped and counted."""

    size: int = limits.EVENT_QUEUE
    dropped: int = 0
    events: deque = field(default_factory=deque)

    def push(self, event: tuple) -> None:
        if len(self.events) == self.size:
            self.events.popleft()
            self.dropped += 1
        self.events.append(event)
