"""Events of followed volumes, read back as a table."""

from __future__ import annotations

import time

from helpers import entry, f, frame, root

from arbordex.functions.scalars import REASONS
from arbordex.sources.snapshots import SnapshotStore
from arbordex.streaming import apply
from arbordex.streaming.events import StreamEvents, counts

RECORDS = "usn long, frn long, parent_frn long, reason long, attributes long, name string"


def settled(events, n):
    """The events once there are n of them; listeners hear of a stream some time after it."""
    for _ in range(100):
        found = events.read().collect()
        if len(found) >= n:
            break
        time.sleep(0.1)
    return found


def test_a_stream_a_rescan_and_a_failure(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", buckets=2)
    store.save(frame(spark, [root(), entry("d", 10, 5, True), entry("n", 50, 10)]), 7, 0)
    events = StreamEvents(spark, f"file://{tmp_path}/events").attach()
    assert events.read().count() == 0 and events.merge() == 0

    def put(*rows):
        spark.createDataFrame(list(rows), RECORDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(RECORDS).parquet(f"{tmp_path}/in")
        query = apply.start(stream, store, f"{tmp_path}/checkpoint")
        try:
            query.awaitTermination()
        except Exception as e:
            return e

    try:
        put((1, f(60), f(10), REASONS["FILE_CREATE"], 0, "new"), (2, f(50), f(10), REASONS["FILE_DELETE"], 0, "n"))
        assert run() is None
        first = settled(events, 3)
        assert sorted((r["kind"], r["n_rows"]) for r in first) == [("changed", 2), ("ended", None), ("ready", None)]
        assert len({r["run"] for r in first}) == 1 and events.merge() == 3
        put((3, f(61), f(99), REASONS["FILE_CREATE"], 0, "lost"))
        assert run() is not None
        found = settled(events, 5)
        rescan = [r for r in found if r["kind"] == "rescan"]
        assert len(rescan) == 1 and "needs a new scan" in rescan[0]["detail"]

        def broken(batch, batch_id):
            raise ValueError("the disk is full")

        stream = spark.readStream.schema(RECORDS).parquet(f"{tmp_path}/in")
        query = stream.writeStream.queryName("vol_d").foreachBatch(broken).option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            pass
        found = settled(events, 7)
        assert [(r["kind"], "the disk is full" in r["detail"]) for r in found if r["label"] == "vol_d" and r["detail"]] == [("failed", True)]
    finally:
        events.detach()
    # merged or not, each event is there once
    before = {(r["run"], r["kind"]) for r in found}
    events.merge()
    assert {(r["run"], r["kind"]) for r in events.read().collect()} == before and events.read().count() == len(found)
    assert {(r["label"], r["kind"]): r["n"] for r in counts(events.read()).collect()}["vol_d", "failed"] == 1
