"""Quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity. Both are estimated on a bounded sample, and the rules are
then ordered by rejections per second of cost, so that most bad documents leave after the cheapest
test that can reject them. The verdict is the conjunction of all rules, hence the order changes the
time and never the result.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: The sample for the plan: about so many documents.
SAMPLE_ROWS = 400

#: The planes that hold letters and marks.
_ASSIGNED = ((0, 0x40000), (0xE0000, 0xE1000))


@lru_cache(1)
def _letter_table() -> np.ndarray:
    """For each code point: 1 for lower case, 2 for upper case, 3 for other letters and for combining marks."""
    table = np.zeros(0x110000, np.uint8)
    for start, stop in _ASSIGNED:
        chars = map(chr, range(start, stop))
        table[start:stop] = [1 if c.islower() else 2 if c.isupper() else 3 * (category(c)[0] in "LM") for c in chars]
    return table


_MIX = np.uint64(0x9E3779B97F4A7C15)


def count_repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found at two or more places of the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ seq[k : k + n]) * _MIX
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    # equal keys are only candidates: the words themselves decide
    at = np.flatnonzero(twin)
    grams = [tuple(seq[p : p + window].tolist()) for p in at]
    seen = Counter(grams)
    starts = at[[seen[g] > 1 for g in grams]]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


class Features:
    """What the rules may ask of one document; each value is computed at its first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return count_repeated_words(self.words)

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_again(self) -> int:
        """Words that equal the word before."""
        w = self.words
        return sum(map(bytes.__eq__, w[1:], w[:-1]))

    @cached_property
    def letters(self) -> tuple[int, int, int]:
        """Letters of all scripts with their combining marks, those with a case, and those in upper case."""
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        _, low, up, other = np.bincount(_letter_table()[points], minlength=4).tolist()
        return low + up + other, low + up, up

    @cached_property
    def n_shouted(self) -> int:
        return sum(w.endswith((b"!!", b"??")) for w in self.words)


@dataclass(frozen=True)
class Rule:
    """name, and the test that is true for documents to reject."""

    name: str
    rejects: Callable[[Features], bool] = field(compare=False)


#: Ratios are generous: clean prose in any of the languages stays far below them.
RULES = (
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("shouted_words", lambda d: 10 * d.n_shouted > 3 * d.n_words),
    Rule("words_in_a_row", lambda d: 10 * d.n_again > 3 * d.n_words),
    Rule("duplicate_lines", lambda d: len(d.lines) >= 4 and 2 * d.n_dup_lines > len(d.lines)),
    Rule("upper_case", lambda d: 2 * d.letters[2] > d.letters[1] > 0),
    Rule("few_letters", lambda d: 2 * d.letters[0] < d.word_chars),
    Rule("frequent_word", lambda d: d.n_words >= 40 and 4 * d.top_word > d.n_words),
    Rule("few_distinct_words", lambda d: d.n_words >= 60 and d.n_distinct**2 < 4 * d.n_words),
)


def _measure(batches: Iterator[pd.DataFrame], rules: tuple[Rule, ...], failed: Callable[[Features], bool]) -> Iterator[pd.DataFrame]:
    """Seconds and verdict of each rule for the documents that pass the base, whose figures the rules find made."""
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            base = Features(text)
            if failed(base):
                continue
            spent, hits = [], []
            for rule in rules:
                doc = copy(base)  # a rule pays for all that it needs beyond the base
                t = time.perf_counter()
                hits.append(bool(rule.rejects(doc)))
                spent.append(time.perf_counter() - t)
            rows.append((spent, hits))
        yield pd.DataFrame(rows, columns=["seconds", "rejected"])


def order_by_gain(seconds: np.ndarray, rejected: np.ndarray) -> list[int]:
    """Rules by rejections per second, each measured on the documents that the rules before it leave."""
    left, order, rest = np.ones(len(seconds), bool), [], list(range(seconds.shape[1]))
    while rest:
        # one is added to the rejections, so that rules which reject nothing more go by their cost
        gain = [(rejected[left, r].sum() + 1) / (left.sum() + 1) / max(float(seconds[left if left.any() else slice(None), r].mean()), 1e-9) for r in rest]
        best = rest.pop(int(np.argmax(gain)))
        order.append(best)
        left &= ~rejected[:, best]
    return order


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, min_words: int = 20, max_repeat_percent: int = 30) -> list[Rule]:
    """The rules, those with the most rejections per second first, on what the base and the rules before leave.

    Cost and selectivity are measured on about sample_rows rows from all parts of the table (twice as
    many at most); they decide only the order. Without a sample the given order stays.
    """
    n = docs.count()
    if not n:
        return list(rules)
    # about sample_rows rows are drawn, from every part; the limit only bounds an unlucky draw
    sample = docs.select("text").sample(min(1.0, sample_rows / n), seed=11).limit(2 * sample_rows).repartition(1)
    failed = base_fails(min_words, max_repeat_percent)
    rows = sample.mapInPandas(lambda it: _measure(it, rules, failed), "seconds array<double>, rejected array<boolean>").collect()
    if not rows:
        return list(rules)
    return [rules[r] for r in order_by_gain(np.array([r["seconds"] for r in rows]), np.array([r["rejected"] for r in rows], bool))]


def base_fails(min_words: int, max_repeat_percent: int) -> Callable[[Features], bool]:
    return lambda d: d.n_words < min_words or 100 * d.n_repeat_words > max_repeat_percent * d.n_words


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base figures, base_failed, and kept: the verdict of the cascade.

    Null and empty texts have no words and fail the base; texts are read whole, whatever their length,
    and length alone rejects none. Rows without doc_id are judged like others. Repeated rows are judged one by one and
    alike; extra columns are ignored; an empty table gives an empty result.
    """
    ordered = plan_cascade(docs, rules, sample_rows, min_words, max_repeat_percent)
    fails = base_fails(min_words, max_repeat_percent)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                d = Features(text)
                failed = fails(d)
                kept = not failed and not any(r.rejects(d) for r in ordered)
                out.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
            figures = list(zip(*out, strict=True)) or [()] * 7
            # ids never leave Arrow: beside a null, pandas would make them floating
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in figures[:5]), *(pa.array(c, pa.bool_()) for c in figures[5:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)
