"""Names that are not valid Unicode: UTF-16 with lone surrogates, kept as WTF-8 bytes.

Paired surrogates become one code point of four bytes, lone ones three bytes each. Valid names stay
in Catalyst; the Python worker sees only the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from .fold import fold_text


def to_wtf8(utf16: bytes) -> bytes:
    return utf16.decode("utf-16-le", "surrogatepass").encode("utf-8", "surrogatepass")


def to_utf16(wtf8: bytes) -> bytes:
    return wtf8.decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass")


def fold_wtf8(wtf8: bytes) -> bytes:
    return fold_text(wtf8.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")


def _bytes_function(f):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: None if b is None else f(bytes(b)))

    return F.pandas_udf(run, BinaryType())


encode = _bytes_function(to_wtf8)
decode = _bytes_function(to_utf16)
folded = _bytes_function(fold_wtf8)


def is_unicode(wtf8: Column) -> Column:
    return F.is_valid_utf8(wtf8.cast("string"))


def matches(wtf8: Column, java: str) -> Column:
    """Whether a Java pattern of plans.regexes finds something; a dot takes a lone surrogate like any character."""
    flags, _, body = java[2:].partition(")")
    body = body.replace(r"\z", r"\Z")

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = regex.compile(body, regex.S | (regex.I if "i" in flags else 0))
        for part in parts:
            yield part.map(lambda b: None if b is None else pattern.search(bytes(b).decode("utf-8", "surrogatepass")) is not None)

    slow = F.pandas_udf(run, BooleanType())
    return F.when(is_unicode(wtf8), F.rlike(wtf8.cast("string"), F.lit(java))).otherwise(slow(F.when(~is_unicode(wtf8), wtf8)))
