"""Versioned snapshots of a catalogue's entries, with more than one writer.

Rows lie in buckets by their object's record number. A version's manifest names, for each bucket, the
folder that holds it, with its row count and a hash of its rows. A small file named by the version
commits it, with the journal's identity and cursor: it is made whole or not at all, and never over
another one, so of two writers of one version the second learns that it is the second. Its rows lie in
a folder of its own; if the versions that came between touch other buckets, it goes behind them, else
it fails with CommitConflict and is to be made again from what stands now. A change writes the buckets
it touches, and the others stay where they are. Readers pin a version; one that was not committed does
not exist for them. Commits, manifests and buckets that only older versions than the last ones have are
deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CommitConflict, SnapshotInvalid
from ..functions.scalars import record
from ..operators import checks

FORMAT = "ARBORDEX02"
COLUMNS = "volume string, volume_ord int, entry_id long, frn long, parent_frn long, name string, is_dir boolean, hidden boolean, system boolean, reparse boolean, tombstone boolean, size long, mtime_secs long"
#: records whose look-ups failed: kind is stat (a size) or links (a link set, all records of the object), since the first such batch
WAITING = "usn long, frn long, parent_frn long, reason long, attributes long, name string, kind string, since long"
_MANIFEST = "bucket int, folder string, n_rows long, checksum long, last_id long, dead long"


@dataclass(frozen=True)
class Meta:
    version: int
    format: str
    journal_id: int
    next_usn: int
    batch_id: int
    n_rows: int
    checksum: int
    #: the largest entry_id that was ever given out
    last_id: int = 0
    buckets: int = 1
    #: of each writer, the last batch that is in the store
    batches: dict[str, int] = field(default_factory=dict)
    #: the last version that made, removed or moved directories
    topology: int = 0
    #: the manifest's folder
    manifest: str = ""
    #: of each writer, the folders of the records that wait for a look-up
    waiting: dict[str, list[str]] = field(default_factory=dict)

    def last_batch(self, writer: str) -> int:
        return self.batches.get(writer, -1)


def names() -> list[str]:
    return [c.split()[0] for c in COLUMNS.split(", ")]


def bucket_of(frn: Column, buckets: int) -> Column:
    """The bucket of an object; all entries of a record number share one."""
    return F.pmod(F.xxhash64(record(frn)), F.lit(buckets)).cast("int")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(F.xxhash64(*names())), F.lit(0)).alias("checksum")]


def _shelves(meta: Meta) -> set[str]:
    return {w for folders in meta.waiting.values() for w in folders}


class SnapshotStore:
    """Versions under path; buckets is for a new store (some 100 MB each), keep the number of versions that stay.

    dead_share: a bucket that a change rewrites loses its tombstones when more than this share of its rows
    are such, and it has at least its part of least_rows; None keeps them all. Ids stay as they are.

    The folder's file system must rename without replacing (HDFS) or link (a local or mounted disk).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, keep: int = 8, dead_share: float | None = 0.125, least_rows: int = 100_000):
        self.spark, self.path, self.buckets, self.keep = spark, path, buckets, keep
        self.dead_share, self.least_rows = dead_share, least_rows

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _delete(self, *paths: str) -> None:
        for path in paths:
            fs, at = self._fs(f"{self.path}/{path}")
            fs.delete(at, True)

    def _commits(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(at))
        return sorted(int(n) for n in found if n.isdigit())

    def _publish(self, version: int, text: str) -> bool:
        """The version's commit with this text, visible at once and whole; False where another writer has made it."""
        fs, at = self._fs(f"{self.path}/commits/{version:020}")
        _, draft = self._fs(f"{self.path}/commits/.draft-{uuid.uuid4().hex}")
        if fs.exists(at):
            return False
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() != "file":
                return fs.rename(draft, at) and not fs.exists(draft)
            # a local rename replaces, a link does not
            file = self.spark._jvm.java.io.File
            self.spark._jvm.java.nio.file.Files.createLink(file(at.toUri().getPath()).toPath(), file(draft.toUri().getPath()).toPath())
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)

    def _meta(self, version: int) -> Meta | None:
        fs, at = self._fs(f"{self.path}/commits/{version:020}")
        try:
            stream = fs.open(at)
        except Py4JJavaError as e:
            if "NotFound" in e.java_exception.getClass().getName():
                return None
            raise
        try:
            return Meta(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def latest(self) -> Meta | None:
        """The last committed version; None for a first run."""
        while found := self._commits():
            # one that is gone by now has newer ones behind it
            if meta := self._meta(found[-1]):
                return meta
        return None

    def save(self, entries: DataFrame, journal_id: int, next_usn: int, batch_id: int = -1, only: list[int] | None = None, base: Meta | None = None, writer: str = "", topology: bool = True, waiting: tuple[list[str], DataFrame | None] | None = None) -> Meta:
        """Rows first, then the file that commits them; the cursor moves with the rows or not at all.

        With only, entries are all rows of these buckets, and the other buckets stay as they are. base is
        the version that entries were made from, the last one if it is not given; topology tells whether
        directories were made, removed or moved. Versions since base that had nothing to do with these
        rows stay, this one goes behind them; for others the error is CommitConflict. waiting: the folders of
        the writer's waiting records that stay and the rows (WAITING) to put beside them; without it all stay.
        """
        base = base or self.latest()
        n_buckets = base.buckets if base else self.buckets
        token = uuid.uuid4().hex[:12]
        folder, listed = f"v={base.version + 1 if base else 1}/{token}", None
        placed = entries.select(*names(), bucket_of(F.col("frn"), n_buckets).alias("bucket"))
        if only is not None:
            placed = placed.where(F.col("bucket").isin(only))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        back = self.spark.read.schema(COLUMNS + ", bucket int").parquet(f"{self.path}/{folder}")
        figures = back.groupBy("bucket").agg(*_sums(), F.max("entry_id").alias("last_id"), F.count_if("tombstone").alias("dead"))
        # one row for each bucket
        own = [(r["bucket"], folder, r["n_rows"], r["checksum"], r["last_id"], r["dead"]) for r in figures.collect()]
        own_last = max([p[4] or 0 for p in own], default=0)
        waits = None
        if waiting is not None:
            waits = list(waiting[0])
            if waiting[1] is not None:
                waits.append(f"w={base.version + 1 if base else 1}/{token}")
                waiting[1].write.parquet(f"{self.path}/{waits[-1]}")
        try:
            while True:
                head = self.latest()
                if base and head and head.version != base.version:
                    self._require_apart(base, head, only, own_last > base.last_id, batch_id, writer, topology)
                elif head and not base:
                    raise CommitConflict(f"version {head.version} was made meanwhile")
                version = head.version + 1 if head else 1
                parts = list(own)
                if only is not None and head:
                    parts += [tuple(p) for p in self._manifest(head) if p["bucket"] not in set(only)]
                listed = f"m={version}/{token}"
                self.spark.createDataFrame(parts, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{listed}")
                total = 0
                for p in parts:
                    total ^= p[3]
                last, cursor, batches, turned, shelves = own_last, next_usn, {writer: batch_id}, version, {}
                if head:
                    last = max(own_last, head.last_id)
                if head and only is not None:  # a change; whole rows begin anew
                    batches = {**head.batches, writer: max(batch_id, head.last_batch(writer))}
                    shelves = head.waiting if waits is None else {**head.waiting, writer: waits}
                    turned = version if topology else head.topology
                    cursor = max(next_usn, head.next_usn) if head.version != base.version else next_usn
                meta = Meta(version, FORMAT, journal_id, cursor, batch_id, sum(p[2] for p in parts), total, last, n_buckets, batches, turned, listed, shelves)
                if self._publish(version, json.dumps(asdict(meta))):
                    break
                self._delete(listed)
        except (CommitConflict, SnapshotInvalid):
            self._delete(folder, *([listed] if listed else []), *([waits[-1]] if waits and waiting[1] is not None else []))
            raise
        self._drop_old(version)
        return meta

    def _require_apart(self, base: Meta, head: Meta, only: list[int] | None, gave_ids: bool, batch_id: int, writer: str, topology: bool) -> None:
        """CommitConflict unless a change of these buckets, made from base, is also right behind head."""
        if only is None:
            raise CommitConflict(f"version {head.version} was made meanwhile")
        if 0 <= batch_id <= head.last_batch(writer):
            raise CommitConflict(f"batch {batch_id} is in version {head.version}")
        if topology or head.topology > base.version:
            raise CommitConflict("directories changed meanwhile")
        if gave_ids and head.last_id > base.last_id:
            raise CommitConflict("ids were given out meanwhile")
        try:
            was = {p["bucket"]: p["folder"] for p in self._manifest(base)}
        except SnapshotInvalid as e:
            raise CommitConflict(f"version {base.version} is too old") from e
        now = {p["bucket"]: p["folder"] for p in self._manifest(head)}
        both = [b for b in only if was.get(b) != now.get(b)]
        if both:
            raise CommitConflict(f"buckets {both} changed meanwhile")

    def _manifest(self, meta: Meta | int) -> list:
        meta = self._meta(meta) if isinstance(meta, int) else meta
        if meta is None:
            raise SnapshotInvalid("the version is gone")
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/{meta.manifest}").collect()
        except AnalysisException as e:
            raise SnapshotInvalid(f"version {meta.version} is gone") from e

    def _drop_old(self, version: int) -> None:
        """Delete the versions that leave the kept range, the first ones first, and the buckets that no kept version names."""
        for gone in [v for v in self._commits() if v <= version - self.keep]:
            try:
                old = {(p["bucket"], p["folder"]) for p in self._manifest(gone)}
                # a bucket that the next version left is in no later one
                old -= {(p["bucket"], p["folder"]) for p in self._manifest(gone + 1)}
            except SnapshotInvalid:  # another writer deletes it too, or one ended while it did
                old = set()
            left, after = self._meta(gone), self._meta(gone + 1)
            if left and after:
                self._delete(*(_shelves(left) - _shelves(after)))
            self._delete(*(f"{folder}/bucket={b}" for b, folder in old), f"m={gone}", f"commits/{gone:020}")

    def vacuum(self, older_than_s: float = 86_400.0) -> list[str]:
        """Delete what writers left that ended before their commit, if nothing in it is younger; returns the folders.

        older_than_s must be above the longest time of a writer from its first row to its commit.
        """
        kept = [m for v in self._commits() if (m := self._meta(v))]
        used = {p["folder"] for m in kept for p in self._manifest(m)} | {m.manifest for m in kept} | {w for m in kept for w in _shelves(m)}
        now, done = time.time() * 1000, []
        fs, root = self._fs(self.path)
        for outer in fs.listStatus(root):
            if not outer.isDirectory() or outer.getPath().getName()[:2] not in ("v=", "m=", "w="):
                continue
            for inner in fs.listStatus(outer.getPath()):
                name = f"{outer.getPath().getName()}/{inner.getPath().getName()}"
                if name not in used and now - inner.getModificationTime() > older_than_s * 1000:
                    self._delete(name)
                    done.append(name)
        return sorted(done)

    def read(self, version: int, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        paths = [f"{self.path}/{p['folder']}/bucket={p['bucket']}" for p in self._manifest(version) if only is None or p["bucket"] in set(only)]
        if not paths:
            return self.spark.createDataFrame([], COLUMNS)
        try:
            return self.spark.read.schema(COLUMNS).parquet(*paths)
        except AnalysisException as e:
            raise SnapshotInvalid(f"a bucket of version {version} is gone") from e

    def waiting(self, meta: Meta, writer: str = "") -> DataFrame:
        """The records of a writer that wait for a look-up."""
        paths = [f"{self.path}/{w}" for w in meta.waiting.get(writer, [])]
        if not paths:
            return self.spark.createDataFrame([], WAITING)
        try:
            return self.spark.read.schema(WAITING).parquet(*paths)
        except AnalysisException as e:
            raise SnapshotInvalid(f"waiting records of version {meta.version} are gone") from e

    def load(self, meta: Meta | None = None, sound: bool = True) -> DataFrame:
        """The rows of a version, checked against its row count, hash and, if asked, the catalogue's rules."""
        meta = meta or self.latest()
        if meta is None:
            raise SnapshotInvalid("no snapshot")
        if meta.format != FORMAT:
            raise SnapshotInvalid(f"format {meta.format}")
        rows = self.read(meta.version)
        if tuple(rows.agg(*_sums()).first()) != (meta.n_rows, meta.checksum):
            raise SnapshotInvalid("rows differ from what was committed")
        if sound:
            checks.require_sound(rows)
        return rows
