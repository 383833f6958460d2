"""Scalar functions over catalogue columns, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import EPOCH_SECONDS, TICKS

RECORD_MASK = (1 << 48) - 1
#: Journal reasons and file attributes (fixed values).
REASONS = {
    "DATA_OVERWRITE": 0x00000001,
    "DATA_EXTEND": 0x00000002,
    "DATA_TRUNCATION": 0x00000004,
    "FILE_CREATE": 0x00000100,
    "FILE_DELETE": 0x00000200,
    "RENAME_OLD_NAME": 0x00001000,
    "RENAME_NEW_NAME": 0x00002000,
    "BASIC_INFO_CHANGE": 0x00008000,
    "HARD_LINK_CHANGE": 0x00010000,
    "CLOSE": 0x80000000,
}
ATTRIBUTES = {"HIDDEN": 0x2, "SYSTEM": 0x4, "DIRECTORY": 0x10, "REPARSE_POINT": 0x400}


def record(frn: Column) -> Column:
    return frn.bitwiseAND(F.lit(RECORD_MASK))


def sequence(frn: Column) -> Column:
    return F.shiftrightunsigned(frn, 48)


def make_frn(sequence_no: int, record_no: Column) -> Column:
    return F.lit(sequence_no << 48).bitwiseOR(record_no.cast("long"))


def entry_ref(volume_ord: Column, entry_id: Column) -> Column:
    return F.shiftleft(volume_ord.cast("long"), 32).bitwiseOR(entry_id)


def has_reason(reason: Column, name: str) -> Column:
    return reason.bitwiseAND(F.lit(REASONS[name])) != 0


def has_attribute(attributes: Column, name: str) -> Column:
    return attributes.bitwiseAND(F.lit(ATTRIBUTES[name])) != 0


def extension(folded: Column, is_dir: Column) -> Column:
    """Text after the last dot of a file's name; null for directories and names without a dot."""
    return F.when(~is_dir & F.contains(folded, F.lit(".")), F.substring_index(folded, ".", -1))


def ticks_of(seconds: Column) -> Column:
    return F.when(seconds == 0, F.lit(0)).otherwise((seconds + EPOCH_SECONDS) * TICKS).cast("long")


def seconds_of(ticks: Column) -> Column:
    seconds = F.floor(ticks / F.lit(TICKS)) - EPOCH_SECONDS
    return F.greatest(F.lit(0), F.least(seconds, F.lit((1 << 32) - 1))).cast("long")


def volume_label(text: Column) -> Column:
    r"""C: from c, C:, c:\; null for anything else."""
    letter = F.regexp_extract(F.trim(text), r"^([A-Za-z]):?\\?$", 1)
    return F.when(letter != "", F.concat(F.upper(letter), F.lit(":")))


def size_text(size: Column, is_dir: Column) -> Column:
    """Bytes below 1024, whole KB, MB with one and GB with two decimals; empty for directories."""

    def in_units(shift: int, unit: str, digits: int) -> Column:
        return F.concat(F.format_number(size / F.lit(float(1 << shift)), digits), F.lit(f" {unit}"))

    return (
        F.when(is_dir, "")
        .when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, in_units(10, "KB", 0))
        .when(size < 1 << 30, in_units(20, "MB", 1))
        .otherwise(in_units(30, "GB", 2))
    )


def date_text(seconds: Column) -> Column:
    """yyyy/MM/dd HH:mm in UTC days and hours; empty for unknown times."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    minute = F.floor(F.pmod(seconds, F.lit(86400)) / 60)
    clock = F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))
    return F.when(seconds <= 0, "").otherwise(F.concat_ws(" ", F.date_format(day, "yyyy/MM/dd"), clock))


def midnight(day: Column, zone: str = "UTC") -> Column:
    """Unix seconds at which a date begins in a time zone, whatever the session's zone is."""
    utc = F.timestamp_seconds(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400)
    return F.unix_seconds(F.to_utc_timestamp(utc, zone)) if zone != "UTC" else F.unix_seconds(utc)
