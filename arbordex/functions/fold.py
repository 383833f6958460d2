"""Case folding that keeps lengths, and canonical (NFC) views of names.

A code point folds to its lower case only if that is a single code point of the same UTF-8 length;
U+0130, U+212A and the like stay as they are, so this is not lower().
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@lru_cache(1)
def fold_pairs() -> tuple[str, str]:
    """The characters that fold and what they fold to, made from the Unicode data by the rule above."""
    source, target = [], []
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        low = c.lower()
        if low != c and len(low) == 1 and len(low.encode()) == len(c.encode()):
            source.append(c)
            target.append(low)
    return "".join(source), "".join(target)


@lru_cache(1)
def _table() -> dict[int, int]:
    return {ord(a): ord(b) for a, b in zip(*fold_pairs(), strict=True)}


def fold_text(text: str) -> str:
    return text.translate(_table())


def changes_by_fold(text: str) -> bool:
    """Whether any character has a lower-case form; decides smart case."""
    return fold_text(text) != text


def fold(name: Column) -> Column:
    return F.translate(name, *fold_pairs())


def has_upper(name: Column) -> Column:
    return fold(name) != name


def nfc_text(text: str) -> str:
    """NFC of each stretch without lone surrogates, which are barriers."""
    return unicodedata.normalize("NFC", text)


def canonical_text(text: str, folded: bool) -> str:
    text = nfc_text(text)
    return nfc_text(fold_text(text)) if folded else text


def needs_canonical(text: str, folded: bool) -> bool:
    """Whether other spellings of the needle exist: non-ASCII, or ASCII that some character decomposes to."""
    return not text.isascii() or any(c in ";`K" or folded and c == "k" for c in text)


@F.pandas_udf(StringType())
def _nfc(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in names:
        yield part.map(nfc_text, na_action="ignore")


@F.pandas_udf(StringType())
def _nfc_folded(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in names:
        yield part.map(lambda s: canonical_text(s, True), na_action="ignore")


def nfc(name: Column) -> Column:
    """NFC; the Python worker sees only the distinct spellings that are not plain ASCII, others pass as they are."""
    return F.when(is_ascii(name), name).otherwise(_nfc(F.when(~is_ascii(name), name)))


def nfc_folded(name: Column) -> Column:
    return F.when(is_ascii(name), fold(name)).otherwise(_nfc_folded(F.when(~is_ascii(name), name)))


def is_ascii(name: Column) -> Column:
    return F.octet_length(name) == F.length(name)
