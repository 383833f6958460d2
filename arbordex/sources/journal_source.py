"""A change journal as a streaming source whose offsets are the journal's own cursors.

    spark.dataSource.register(JournalSource)
    spark.readStream.format("arbordex_journal").option("path", ...).option("journalId", 7).option("startUsn", 60).load()

A journal is a folder with journal.json (journal_id, first_usn, next_usn, state) and a file for each
buffer, named <first>-<next>.usn by the number of its first record and of the one behind its last, in
twenty digits each. A host writes a buffer whole before it moves next_usn, and may delete buffers below
first_usn. Rows are those of journal.records. The source fails with JournalGone, whose text ends with
one of the four conditions, as soon as the journal no longer has what stands between two offsets; no
row of such a batch is given out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import RescanRequired
from .journal import RECORDS, batch_of, buffer_rows

NAME = "arbordex_journal"
_FILE = re.compile(r"(\d{20})-(\d{20})\.usn")


class JournalGone(RescanRequired):
    """The journal was deleted, is being deleted, is not active, or has lost records behind the cursor."""


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def status(path: str) -> dict | None:
    """What journal.json says; None without one."""
    fs, at = _open(path)
    if fs.get_file_info(f"{at}/journal.json").type != arrow_fs.FileType.File:
        return None
    with fs.open_input_stream(f"{at}/journal.json") as f:
        return json.loads(f.read())


def buffers(path: str) -> list[tuple[int, int]]:
    """(first, next) of all buffers, in order."""
    fs, at = _open(path)
    found = (_FILE.fullmatch(i.base_name) for i in fs.get_file_info(arrow_fs.FileSelector(at)))
    return sorted((int(m[1]), int(m[2])) for m in found if m)


def write_status(path: str, journal_id: int, first_usn: int, next_usn: int, state: str = "active") -> None:
    fs, at = _open(path)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/journal.tmp") as f:
        f.write(json.dumps({"journal_id": journal_id, "first_usn": first_usn, "next_usn": next_usn, "state": state}).encode())
    fs.move(f"{at}/journal.tmp", f"{at}/journal.json")


def write_buffer(path: str, first: int, after: int, payload: bytes) -> None:
    fs, at = _open(path)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/{first:020}.tmp") as f:
        f.write(payload)
    fs.move(f"{at}/{first:020}.tmp", f"{at}/{first:020}-{after:020}.usn")


@dataclass
class Stretch(InputPartition):
    """Neighbouring buffers that one task reads, and the cursor below which records are known."""

    files: list[tuple[int, int]]
    cursor: int


class JournalReader(DataSourceStreamReader):
    def __init__(self, path: str, journal_id: int, start: int, per_task: int):
        self.path, self.journal_id, self.start, self.per_task = path, journal_id, start, per_task

    def _standing(self, cursor: int) -> dict:
        now = status(self.path)
        if now is None or now["journal_id"] != self.journal_id:
            raise JournalGone("journal gone: journal deleted")
        if now["state"] != "active":
            raise JournalGone(f"journal gone: {now['state']}")
        if cursor < now["first_usn"]:
            raise JournalGone("journal gone: entry deleted")
        return now

    def initialOffset(self) -> dict:
        return {"usn": self.start}

    def latestOffset(self) -> dict:
        return {"usn": max(self._standing(self.start)["next_usn"], self.start)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        cursor = start["usn"]
        self._standing(cursor)
        files = [(a, b) for a, b in buffers(self.path) if b > cursor and a < end["usn"]]
        at = cursor
        for a, b in files:
            # a first buffer may begin before the cursor, the others join without a gap
            if a > at:
                break
            at = b
        if at < end["usn"]:
            raise JournalGone("journal gone: entry deleted")
        # from here on the journal may move on without harm to the batch
        self.start = max(self.start, cursor)
        return [Stretch(files[i : i + self.per_task], cursor) for i in range(0, len(files), self.per_task)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, at = _open(self.path)
        for first, after in partition.files:
            try:
                with fs.open_input_stream(f"{at}/{first:020}-{after:020}.usn") as f:
                    payload = f.read()
            except FileNotFoundError:
                raise JournalGone("journal gone: entry deleted") from None
            yield batch_of([r for r in buffer_rows(first, payload) if r[2] is None or r[2] >= partition.cursor])


class JournalSource(DataSource):
    """Options: path, journalId, startUsn (the cursor of a first start; a checkpoint knows its own), buffersPerTask (64)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RECORDS

    def streamReader(self, schema) -> JournalReader:
        o = self.options
        return JournalReader(o["path"], int(o["journalId"]), int(o.get("startUsn", 0)), int(o.get("buffersPerTask", 64)))
