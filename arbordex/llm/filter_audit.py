"""What each quality filter removes in each order of the filters, from packed bitmaps.

A task holds its rows as NumPy bitsets: one for each filter that a row may fail, one for each label,
one for each part. For a set of filters that come first, the rows left are the part's bitset AND NOT
the filters' bitsets, and a popcount tells how many; so a part has one count for each of the 32 sets,
whatever the orders are. Counts of tasks are summed, and the 120 orders read them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _hot_keys
from ._shared import materialize

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: A: fewer words; B: a smaller percentage of distinct words; C: a larger percentage of capitals; D: any of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: A task sums the counts of so many parts before it gives them out.
PARTS = 4096
_REPEATED = 1 << FILTERS.index("E")


def failed(text: str) -> int:
    """The filters A to D that a text fails, as bits."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    few = n < LEAST_WORDS
    same = 100 * len(set(words)) < LEAST_DISTINCT * n
    capitals = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | same << 1 | capitals << 2 | symbols << 3


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to D) and key (128 bits of the text) of each row, without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(map(failed, texts), pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "fails", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, fails int, key binary")


class Bitmaps:
    """The bitsets of some rows; those of a part lie beside each other, so its bitset is a stretch of few bytes."""

    def __init__(self, parts: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        order = np.argsort(parts, kind="stable")
        self.parts = parts[order]
        fails = fails[order]
        filters = [np.packbits((fails >> f & 1).astype(bool)) for f in range(len(FILTERS))]
        self.labels = [np.packbits(x[order]) for x in (good, toxic)]
        # for each set of filters the rows that fail any of it
        self.out = np.zeros((SETS, len(filters[0])), np.uint8)
        for s in range(1, SETS):
            f = s.bit_length() - 1
            self.out[s] = self.out[s & ~(1 << f)] | filters[f]

    def counts(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each part an array [kept, good, toxic] x sets: the rows that fail no filter of the set."""
        edges = np.flatnonzero(np.r_[True, self.parts[1:] != self.parts[:-1], True]) if len(self.parts) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lo, hi = a // 8, -(-b // 8)
            part = np.zeros(8 * (hi - lo), bool)
            part[a - 8 * lo : b - 8 * lo] = True
            left = np.packbits(part) & ~self.out[:, lo:hi]
            sets = [left, *[left & x[lo:hi] for x in self.labels]]
            yield int(self.parts[a]), np.stack([np.bitwise_count(x).sum(1, dtype=np.int64) for x in sets])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        whole = np.concatenate([*sums.values()], axis=1) if sums else np.zeros((3, 0), np.int64)
        columns = [pa.array(np.repeat(np.array([*sums], object), SETS), pa.string()), pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(sums)))]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, whole)], ["part", "held", "kept", "good", "toxic"])

    for batch in batches:
        coded = pc.dictionary_encode(batch.column("part"))
        names = coded.dictionary.to_pylist()
        flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic")]
        rows = Bitmaps(coded.indices.to_numpy(zero_copy_only=False), batch.column("fails").to_numpy(zero_copy_only=False), *flags)
        for code, found in rows.counts():
            name = names[code]
            sums[name] = sums[name] + found if name in sums else found
        if len(sums) > PARTS:
            yield out()
            sums = {}
    if sums:
        yield out()


def set_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, held (a set of filters, as bits), kept, good, toxic: the rows of the part that fail none of the set.

    A text's first row is that of its least doc_id. Texts are told apart by 128 bits, so no text is
    shuffled; a text or a doc_id that a large part of all rows has is joined without a shuffle.
    """
    rows = materialize(judged(docs), "judged")
    n = rows.count()
    copies = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    rows = _hot_keys.left_join(rows, copies.select("key", "first_id"), "key", _hot_keys.hot_keys(copies, "key", n))
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    rows = rows.select("doc_id", "part", F.when(again, F.col("fails").bitwiseOR(F.lit(_REPEATED))).otherwise(F.col("fails")).alias("fails"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _hot_keys.left_join(rows, marks, "doc_id", _hot_keys.hot_keys(repeated.where("doc_id is not null"), "doc_id", n))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    counts = rows.select("part", "fails", *flags).mapInArrow(_counted, "part string, held int, kept long, good long, toxic long")
    return counts.groupBy("part", "held").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def _orders() -> str:
    """The steps of all orders as JSON: the filters before, and the filter itself."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append({"filter_order": order, "step": step, "before": before, "bit": bit})
            before |= bit
    return json.dumps(steps)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    Whole texts are judged, whatever their length; a null text is empty. A null source is the part of
    the empty string. E is failed by a row whose text a smaller doc_id has: a row without doc_id never
    fails it and makes no other fail it, and rows with one doc_id do not make each other fail it.
    Repeated rows count one by one. Several labels of a doc_id: it is good or toxic if any of them says
    so; labels without doc_id are left out. Extra columns are ignored; an empty table has no parts.
    """
    counts = set_counts(docs, labels)
    slots = F.sort_array(F.collect_list(F.struct("held", "kept", "good", "toxic")))  # 32 of each part
    parts = counts.groupBy("part").agg(slots.alias("s"))
    step = F.explode(F.from_json(F.lit(_orders()), "array<struct<filter_order:string,step:int,before:int,bit:int>>"))
    rows = parts.select("part", "s", step.alias("o")).select("part", "s", "o.*")

    def at(held, column: str):
        return F.element_at("s", (held + 1).cast("int"))[column]

    before, bit, whole = F.col("before"), F.col("bit"), F.lit(SETS - 1)
    after = before.bitwiseOR(bit)
    removed = at(before, "kept") - at(after, "kept")
    rows = rows.select(
        "part", "filter_order", "step", "bit", at(after, "kept").alias("kept"), removed.alias("removed"),
        (at(F.lit(0), "kept") - at(bit, "kept") - removed).alias("redundant"),
        (at(whole - bit, "kept") - at(whole, "kept")).alias("unique_fails"),
        (at(before, "good") - at(after, "good")).alias("good_lost"), (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
