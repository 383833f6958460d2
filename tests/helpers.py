"""Small catalogues for tests."""

from __future__ import annotations

from arbordex.sources.snapshots import COLUMNS

ROOT = 5
DAY = 86400


def f(record: int, sequence: int = 1) -> int:
    return sequence << 48 | record


def entry(name, record, parent, is_dir=False, size=0, mtime=0, hidden=False, system=False, volume="C:", ord_=0, entry_id=None):
    """A row of the snapshot columns; parent None is a root."""
    return (volume, ord_, record if entry_id is None else entry_id, f(record), None if parent is None else f(parent), name, is_dir, hidden, system, False, False, size, mtime)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def root(volume="C:", ord_=0):
    return entry(volume, ROOT, None, True, volume=volume, ord_=ord_)


def sample():
    """A garden: two levels of directories, spellings in both cases, sizes from bytes to gigabytes."""
    return [
        root(),
        entry("Garden", 50, 5, True, 0, 900 * DAY),
        entry("seeds", 51, 50, True, 0, 17000 * DAY),
        entry("beans_2019.csv", 52, 51, False, 90, 17950 * DAY),
        entry("beans_2020.csv", 53, 51, False, 1500, 18310 * DAY),
        entry("Tomato Plan.ods", 54, 51, False, 7 << 20, 18000 * DAY),
        entry("Pond.JPEG", 55, 50, False, 5 << 30, 18500 * DAY),
        entry("tools", 70, 5, True, 0, 18600 * DAY),
        entry("water.py", 71, 70, False, 20_000, 18700 * DAY),
    ]
