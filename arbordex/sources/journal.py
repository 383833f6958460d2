"""Change records from binary journal buffers.

A buffer is a little-endian 64-bit cursor and records of 8-aligned length; version 2 is decoded,
valid versions 3 and 4 are skipped, anything else marks the buffer as truncated.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RECORDS = "buffer_id long, next_usn long, usn long, frn long, parent_frn long, reason long, attributes long, name string, truncated boolean"
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in RECORDS.split(", ")])
#: a task hands decoded records on as soon as it has so many, however many buffers came to it at once
BATCH_ROWS = 8192
_V2 = struct.Struct("<IHHQQqqIIIIHH")  # length .. name offset, 60 bytes


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _name(raw: bytes, length: int, fixed: int, at: int) -> bytes | None:
    """The name's UTF-16 bytes if its place lies within the record."""
    size, start = struct.unpack_from("<HH", raw, at)
    ok = size % 2 == 0 and start % 2 == 0 and start >= fixed and start + size <= length
    return raw[start : start + size] if ok else None


def _extents_fit(raw: bytes, length: int) -> bool:
    if length < 64:
        return False
    n, size = struct.unpack_from("<HH", raw, 60)
    return size >= 16 and 64 + n * size <= length


def decode(buffer: bytes) -> tuple[int, list[tuple], bool]:
    """(next cursor, records (usn, frn, parent_frn, reason, attributes, name), truncated)."""
    if len(buffer) < 8:
        return 0, [], True
    out, at, bad = [], 8, False
    while at + 60 <= len(buffer):
        length, version = struct.unpack_from("<IH", buffer, at)
        if length < 60 or length % 8 or at + length > len(buffer):
            return struct.unpack_from("<q", buffer)[0], out, True
        raw = buffer[at : at + length]
        name = _name(raw, length, 60, 56) if version == 2 else None
        if name is not None:
            f = _V2.unpack_from(raw)
            out.append((f[5], _signed(f[3]), _signed(f[4]), f[7], f[10], name.decode("utf-16-le", "surrogatepass")))
        elif not (version == 3 and length >= 76 and _name(raw, length, 76, 72) is not None or version == 4 and _extents_fit(raw, length)):
            bad = True
        at += length
    return struct.unpack_from("<q", buffer)[0], out, bad or at != len(buffer)


def encode(next_usn: int, records: list[tuple]) -> bytes:
    """A buffer of version 2 records, for tests and replays."""
    parts = [struct.pack("<q", next_usn)]
    for usn, frn, parent, reason, attributes, name in records:
        raw = name.encode("utf-16-le", "surrogatepass")
        length = -(-(60 + len(raw)) // 8) * 8
        head = _V2.pack(length, 2, 0, frn % (1 << 64), parent % (1 << 64), usn, 0, reason, 0, 0, attributes, len(raw), 60)
        parts.append((head + raw).ljust(length, b"\0"))
    return b"".join(parts)


def packed(records: Iterable[tuple], n: int, torn: bool = False) -> Iterator[tuple[int, bytes]]:
    """(number of the first record, buffer) for n neighbouring records at most, for tests and replays.

    A buffer ends where numbers do not follow one another. Torn ones have a tail that is no record where
    the last number is 3 mod 4.
    """
    part: list[tuple] = []

    def buffer() -> tuple[int, bytes]:
        last = part[-1][0]
        return part[0][0], encode(last + 1, part) + (b"x" * 7 if torn and last % 4 == 3 else b"")

    for r in records:
        if part and (len(part) == n or r[0] != part[-1][0] + 1):
            yield buffer()
            part = []
        part.append(r)
    if part:
        yield buffer()


def buffer_rows(buffer_id: int, payload: bytes | None) -> list[tuple]:
    """A buffer's rows of RECORDS; one with null usn for a buffer without records. Lone surrogates are replaced."""
    cursor, found, bad = decode(bytes(payload or b""))
    rows = []
    for r in found or [(None,) * 6]:
        name = r[5].encode("utf-8", "replace").decode() if r[5] is not None else None
        rows.append((buffer_id, cursor, *r[:5], name, bad))
    return rows


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of RECORDS as one batch."""
    columns = zip(*rows, strict=True) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def records(buffers: DataFrame) -> DataFrame:
    """Rows of decoded records from (buffer_id, payload); a buffer without records gives one row with null usn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for buffer_id, payload in zip(*batch.columns, strict=True):
                rows += buffer_rows(buffer_id.as_py(), payload.as_py())
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return buffers.select("buffer_id", "payload").mapInArrow(run, RECORDS)
