"""What happens to followed volumes, as an appended table: a listener of streaming queries writes one row for each event.

Kinds: ready (a stream has begun), changed (a batch with records went in), rescan (a stream ended because the
volume must be scanned anew), failed (it ended with another error), ended (it ended by itself or was stopped).
"""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = "at timestamp, label string, run string, kind string, batch_id long, n_rows long, detail string"
_RESCAN = ("RescanRequired", "JournalGone")


class StreamEvents(StreamingQueryListener):
    """Writes events of the session's streaming queries under path; label is the query's name, null where it has none.

    An event is a small file of its own, made whole before it is seen, so several drivers may share a path.
    merge() makes one table of those that are there. Progress without records makes no row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._names: dict[str, str | None] = {}
        self._lock = threading.Lock()

    def attach(self) -> StreamEvents:
        self.spark.streams.addListener(self)
        return self

    def detach(self) -> None:
        self.spark.streams.removeListener(self)

    def _put(self, run, kind: str, batch_id: int | None = None, n_rows: int | None = None, detail: str | None = None) -> None:
        with self._lock:
            label = self._names.get(str(run))
        row = {"at": datetime.now(timezone.utc).isoformat(), "label": label, "run": str(run), "kind": kind, "batch_id": batch_id, "n_rows": n_rows, "detail": detail}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        # files whose name begins with a dot are not read
        draft, at = folder(f"{self.path}/new/.{uuid.uuid4().hex}"), folder(f"{self.path}/new/{uuid.uuid4().hex}.json")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        fs.rename(draft, at)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._names[str(event.runId)] = event.name
        self._put(event.runId, "ready")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self._put(p.runId, "changed", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        error = event.exception
        kind = "ended" if not error else "rescan" if any(e in error for e in _RESCAN) else "failed"
        self._put(event.runId, kind, detail=error)
        with self._lock:
            self._names.pop(str(event.runId), None)

    def _there(self, name: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._"]

    def read(self) -> DataFrame:
        """All events, those that were merged with those that came since; one that is in both is one."""
        out = self.spark.createDataFrame([], EVENTS)
        if merged := self._there("merged"):
            out = out.unionByName(self.spark.read.schema(EVENTS).parquet(*merged))
        if new := self._there("new"):
            out = out.unionByName(self.spark.read.schema(EVENTS).json(new))
        return out.distinct()

    def merge(self) -> int:
        """Move the small files into a table; how many there were. One caller at a time."""
        new = self._there("new")
        if new:
            self.spark.read.schema(EVENTS).json(new).coalesce(1).write.parquet(f"{self.path}/merged/{uuid.uuid4().hex}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in new:
            folder(path).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder(path), False)
        return len(new)


def counts(events: DataFrame) -> DataFrame:
    """How many events of each kind a label has, and when the last one was."""
    return events.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
