"""User patterns as Java patterns, limited to what matches in linear time."""

from __future__ import annotations

import re

import regex
from pyspark.sql import SparkSession

from .. import limits
from ..errors import QuerySyntaxError

_UNSUPPORTED = (
    (re.compile(r"\(\?(?:[=!>]|<[=!])"), "look-around or atomic group"),
    (re.compile(r"\\(?:[1-9]|k[<{'])"), "back-reference"),
    (re.compile(r"[*+?}]\+"), "possessive quantifier"),
)


def escape(literal: str) -> str:
    """Backslashes before all ASCII marks."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", literal)


def from_wildcard(pattern: str) -> str:
    return "".join(".*" if c == "*" else "." if c == "?" else escape(c) for c in pattern)


def _units(pattern: str):
    """(text, in_class) of each escape or character."""
    depth = 0
    for m in re.finditer(r"\\.|.", pattern, re.S):
        c = m[0]
        inside = depth > 0
        depth += (c == "[") - (c == "]" and inside)
        yield c, inside or c == "["


def states(pattern: str) -> int:
    """About how many automaton states the pattern needs; counted repetitions multiply."""
    stack, atom, at = [0], 1, 0
    plain = re.sub(r"\[(?:\\.|[^\]\\])*\]|\\[pP]\{[^}]*\}|\\.", "c", pattern, flags=re.S)
    while at < len(plain):
        c = plain[at]
        repeat = re.match(r"\{(\d+)(,?)(\d*)\}", plain[at:])
        if c == "(":
            stack.append(0)
        elif c == ")" and len(stack) > 1:
            atom = max(1, stack.pop())
            stack[-1] += atom
        elif repeat:
            low, comma, high = repeat.groups()
            if high and int(high) < int(low):
                raise QuerySyntaxError(f"bad repetition: {repeat[0]}")
            stack[-1] += atom * (max(int(low), int(high or 0), 1) - 1)
            at += repeat.end() - 1
        elif c not in "*+?|^$":
            atom = 1
            stack[-1] += 1
        at += 1
    return sum(stack)


def to_java(pattern: str, insensitive: bool) -> str:
    """A Java pattern that finds what the user's pattern finds: dot takes newlines, $ is the very end."""
    outside = "".join(c if not inside else "c" for c, inside in _units(pattern))
    for found, what in _UNSUPPORTED:
        if found.search(re.sub(r"\\[^1-9k]", "", outside)):
            raise QuerySyntaxError(f"{what} in {pattern}")
    if states(pattern) > limits.MAX_REGEX_STATES:
        raise QuerySyntaxError(f"pattern too large: {pattern}")
    multiline = re.search(r"\(\?[a-z]*m", outside)
    body = "".join(r"\z" if c == "$" and not inside and not multiline else c for c, inside in _units(pattern))
    body = body.replace("(?P<", "(?<")
    java = f"(?{'iu' if insensitive else ''}sU){body}"
    check(java, pattern)
    return java


def check(java: str, shown: str) -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(java)
        else:  # without a session, the nearest dialect
            regex.compile(java.replace(r"\z", r"\Z").partition(")")[2])
    except Exception as e:  # noqa: BLE001  the engine's error becomes the interface's
        raise QuerySyntaxError(f"bad pattern: {shown}") from e
