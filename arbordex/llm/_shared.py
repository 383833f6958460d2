"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize

__all__ = ["SPACE_CHARS", "SPACE_CLASS", "WORD_REGEX", "blocks", "materialize", "spread", "text_or_empty"]

#: ASCII white space, as a regular-expression class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word is a longest run of anything else.
WORD_REGEX = rf"[^{SPACE_CLASS}]+"

def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def blocks(texts: list[str], chars: int) -> Iterator[slice]:
    """Slices of about so many characters, so that what is made of a block stays small."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores if it has fewer parts than there are (one small file, say); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
