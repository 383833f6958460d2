"""Size and date literals of the query language."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

U64 = (1 << 64) - 1
#: Seconds from 1601-01-01 to 1970-01-01, and ticks per second, of file times.
EPOCH_SECONDS = 11_644_473_600
TICKS = 10_000_000
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
_SIZE = re.compile(r"\s*(.*?)\s*([kmgt]b?|b)?\s*", re.S)
_FLOAT = re.compile(r"\+?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?", re.A)


def size_literal(text: str) -> int | None:
    """Bytes, or None if the text is no size: 123, 1kb, 1.5 mb, 1e3."""
    m = _SIZE.fullmatch(text.lower())
    number, shift = m[1], _UNITS[m[2] or ""]
    if re.fullmatch(r"\+?\d+", number, re.A) and int(number) <= U64:
        value = int(number) << shift
        return value if value <= U64 else None
    if not _FLOAT.fullmatch(number):
        return None
    value = float(number)
    return min(int(value * (1 << shift)), U64) if value < float("inf") else None


def _compared(text: str) -> tuple[str, str]:
    op = re.match(r"[<>]=?", text)
    return (op[0], text[op.end() :]) if op else ("", text)


def size_range(text: str) -> tuple[int, int] | None:
    """Inclusive bounds; an inverted range is valid and matches nothing."""
    if ".." in text:
        low, high = map(size_literal, text.split("..", 1))
        return None if low is None or high is None else (low, high)
    op, rest = _compared(text)
    n = size_literal(rest)
    if n is None or (op == ">" and n == U64) or (op == "<" and n == 0):
        return None
    return {"": (n, n), ">": (n + 1, U64), ">=": (n, U64), "<": (0, n - 1), "<=": (0, n)}[op]


def date_period(text: str) -> tuple[date, date | None] | None:
    """First day and the day after the last of a year, month or day; None after the last day of 9999."""
    parts = re.split("[-/]", text.strip())
    if len(parts) > 3 or not all(re.fullmatch(r"\+?\d+", p, re.A) for p in parts):
        return None
    numbers = [int(p) for p in parts]
    if not 1601 <= numbers[0] <= 9999 or (len(numbers) == 1 and numbers[0] == 9999):
        return None
    try:
        first = date(*(numbers + [1, 1])[:3])
        if len(numbers) == 1:
            return first, date(first.year + 1, 1, 1)
        if len(numbers) == 2:
            return first, (first.replace(day=28) + timedelta(days=4)).replace(day=1)
        return first, first + timedelta(days=1)
    except OverflowError:
        return first, None
    except ValueError:
        return None


def date_range(text: str) -> tuple[date | None, date | None] | None:
    """[start, end) in civil days; None is an open end."""
    if ".." in text:
        low, high = map(date_period, text.split("..", 1))
        return None if low is None or high is None else (low[0], high[1])
    op, rest = _compared(text)
    period = date_period(rest)
    if period is None:
        return None
    return {"": period, ">": (period[1], None), ">=": (period[0], None), "<": (None, period[0]), "<=": (None, period[1])}[op]


def midnight_seconds(day: date, zone: str = "UTC") -> int:
    """Unix seconds of the local midnight that begins a civil day."""
    at = datetime(day.year, day.month, day.day, tzinfo=timezone.utc if zone == "UTC" else ZoneInfo(zone))
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())


def ticks_to_seconds(ticks: int) -> int:
    """Stored seconds of a file time: 0 for unknown or before 1970, saturating at 32 bits."""
    return min(max(ticks // TICKS - EPOCH_SECONDS, 0), (1 << 32) - 1)


def seconds_to_ticks(seconds: int) -> int:
    return 0 if seconds == 0 else (seconds + EPOCH_SECONDS) * TICKS
