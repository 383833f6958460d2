"""Where a query's positive literals match a row, for display.

Substrings, prefixes and suffixes are marked, in the row's path where the term is one on paths, else
in its name; patterns of whole-regex queries are marked with their own matches. Negated terms,
general wildcards and field terms mark nothing. Overlapping and touching ranges are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from ..plans.compiler import Matcher, Plan
from .fold import canonical_text, fold_text

RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("len", LongType())]))
#: Seconds that one pattern may take on one name or path by default; a column tells where it took longer.
PATTERN_SECONDS = 10.0


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (start, stop) without overlaps and gaps of nothing."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(r for r in ranges if r[1] > r[0]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _literal_ranges(m: Matcher, text: str) -> list[tuple[int, int]]:
    seen = canonical_text(text, m.folded) if m.canonical else fold_text(text) if m.folded else text
    if len(seen) != len(text):  # another spelling: no place of it is a place of the text
        return []
    n = len(m.value)
    if m.kind == "prefix":
        return [(0, n)] if seen.startswith(m.value) else []
    if m.kind == "suffix":
        return [(len(seen) - n, len(seen))] if seen.endswith(m.value) else []
    return [(f.start(), f.start() + n) for f in re.finditer(f"(?={re.escape(m.value)})", seen)]


def _pattern_ranges(java: str, text: str, seconds: float) -> list[tuple[int, int]] | None:
    """The pattern's matches, None where it takes longer than seconds."""
    flags, _, body = java[2:].partition(")")
    pattern = regex.compile(body.replace(r"\z", r"\Z"), regex.S | (regex.I if "i" in flags else 0))
    try:
        return [f.span() for f in pattern.finditer(text, timeout=seconds)]
    except TimeoutError:
        return None


def ranges(plan: Plan, name: str, path: str, seconds: float = PATTERN_SECONDS) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Marked ranges of the name, and of the parent path before it."""
    return timed_ranges(plan, name, path, seconds)[:2]


def timed_ranges(plan: Plan, name: str, path: str, seconds: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The same, and whether a pattern took too long and marks nothing."""
    cut, late = len(path) - len(name), False
    on_name, on_path = [], []
    for m in (m for g in plan.groups for m in g if not m.negated):
        if m.kind in ("contains", "prefix", "suffix"):
            on_name += _literal_ranges(m, name)
        elif m.kind == "path":
            on_path += _literal_ranges(m, path)
        elif plan.options.whole_regex != "none" and m.kind in ("regex", "path_regex"):
            found = _pattern_ranges(m.value, path if m.on_path else name, seconds)
            late |= found is None
            (on_path if m.on_path else on_name).extend(found or [])
    inside = [(max(a, cut) - cut, b - cut) for a, b in on_path if b > cut]
    before = [(a, min(b, cut)) for a, b in on_path if a < cut]
    return merge(on_name + inside), merge(before), late


def highlighted(rows: DataFrame, plan: Plan, seconds: float = PATTERN_SECONDS) -> DataFrame:
    """rows (with name and path) and name_marks, path_marks: arrays of (start, len) in code points.

    marks_late: a pattern took longer than seconds on the row's text and marks nothing there. Whether it
    does depends on the machine, so a caller that needs equal results everywhere asks for the column.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def listed(found):
            return [{"start": a, "len": b - a} for a, b in found]

        for names, paths in batches:
            found = [timed_ranges(plan, n, p, seconds) for n, p in zip(names, paths, strict=True)]
            yield pd.DataFrame({"name_marks": [listed(a) for a, _, _ in found], "path_marks": [listed(b) for _, b, _ in found], "marks_late": [late for _, _, late in found]})

    marks = F.pandas_udf(run, StructType([StructField("name_marks", RANGES), StructField("path_marks", RANGES), StructField("marks_late", BooleanType())]))
    return rows.withColumn("__m", marks("name", "path")).select("*", "__m.name_marks", "__m.path_marks", "__m.marks_late").drop("__m")
