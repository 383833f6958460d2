"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits falls into segments. A pair that differs in at most 4 bits agrees, in some
segment, up to that segment's radius, if the radii plus one add up to more than 4: five segments need
no radius, four need radius 1 in one of them, three in two, two need radii 2 and 1. Each fingerprint
is filed under its segment values and looks up the Hamming ball of the radius around them. Long
segments have larger balls but fewer fingerprints in an entry, so the layout is chosen by the number
of fingerprints. Of a pair that differs within a ball the side with the zero bits looks up the other,
so only zero bits are turned. Every match is verified on all 64 bits.

Entries with more than LARGE fingerprints are divided by a second table over the bits outside their
segment, in the same manner. Distinct fingerprints take part once, whatever the number of their
documents. Within an entry linked fingerprints give a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import star_components
from ._shared import materialize

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Radii of the segments of each layout: MOST_BITS differing bits cannot exceed all of them.
LAYOUTS = ((0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0), (2, 1))
#: Microseconds, about, to file one row and to compare one pair.
_ROW_COST, _PAIR_COST = 1.0, 0.003
#: An entry with more fingerprints is divided.
LARGE = 4096
#: Entries up to this size are compared by shifts of the sorted rows, those up to the next in one matrix, larger ones by a traversal.
_SMALL, _MATRIX = 12, 256

#: Large entries are broadcast up to this number, else joined by a shuffle.
BROADCAST_ENTRIES = 500_000

Segments = tuple[tuple[int, int, int], ...]


def layout(n_prints: int, bits: int = 64) -> Segments:
    """(lowest bit, width, radius) of each segment: the layout with the least cost for so many fingerprints."""

    def made(radii: tuple[int, ...]) -> Segments:
        widths = [bits // len(radii) + (i < bits % len(radii)) for i in range(len(radii))]
        return tuple((sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii, strict=True)))

    def cost(segments: Segments) -> float:
        rows = sum(sum(comb(w, k) / 2**k for k in range(r + 1)) for _, w, r in segments)
        pairs = sum(n_prints * sum(comb(w, k) for k in range(r + 1)) / 2**w / 2 for _, w, r in segments)
        return rows * _ROW_COST + pairs * _PAIR_COST

    return min(map(made, LAYOUTS), key=cost)


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    stops = (starts + lens)[SHINGLE - 1 :]
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints)], ["doc_id", "row", "fp"])


def row_key() -> Column:
    """Identifies a document row by 128 bits; equal rows share it."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(SEED), "text", "doc_id").alias("b"))


_ROW = "row struct<a:long,b:long>"


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp) of each row, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return materialize(rows.mapInArrow(_fingerprints, f"doc_id long, {_ROW}, fp long"), "prints")


def table_keys(fp: Column, segments: Segments) -> Column:
    """All table entries (number of the segment, value) of a fingerprint: its own, and those in the balls that it looks up."""
    keys = []
    for n, (low, width, radius) in enumerate(segments):
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        keys.append(F.struct(F.lit(n).cast("byte").alias("segment"), value.alias("value")))
        for k in range(1, radius + 1):
            for turned in combinations(range(width), k):
                mask = F.lit(sum(1 << b for b in turned)).cast("long")
                keys.append(F.when(value.bitwiseAND(mask) == 0, F.struct(F.lit(n).cast("byte").alias("segment"), value.bitwiseOR(mask).alias("value"))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def other_bits(fp: Column, segment: Column, segments: Segments) -> Column:
    """A fingerprint without the bits of a segment, the rest moved together."""
    found = F.lit(None).cast("long")
    for n, (low, width, _) in enumerate(segments):
        below = fp.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
        above = F.shiftleft(F.shiftrightunsigned(fp, low + width), low) if low + width < 64 else F.lit(0).cast("long")
        found = F.when(segment == n, above.bitwiseOR(below)).otherwise(found)
    return found


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def _forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one entry; each print that is reached leaves the search."""
    out, rest = [], prints
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            hit = _near(rest, at)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                out.append((np.full(len(found), at), found))
                stack.extend(found)
    return out


def _star(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each print of an entry to the first that it is connected with."""
    near = _near(prints[:, None], prints[None, :])
    first = np.arange(len(prints))
    while True:
        now = np.where(near, first[None, :], len(prints)).min(1)
        now = now[now]
        if (now == first).all():
            break
        first = now
    own = np.flatnonzero(first != np.arange(len(prints)))
    return prints[own], prints[first[own]]


def _links_of(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with the same key; keys are sorted."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    found = []
    for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        found += [_star(prints[s : s + n])] if n <= _MATRIX else _forest(prints[s : s + n])
    few = np.repeat((sizes <= _SMALL) & (sizes > 1), sizes)
    k, p = keys[few], prints[few]
    for lag in range(1, _SMALL):
        at = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(at):
            break
        at = at[_near(p[at], p[at + lag])]
        found.append((p[at], p[at + lag]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _link_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entry (segment, value, segment2, value2); an entry may reach over several batches."""

    def made(keys, prints):
        a, b = _links_of(keys, prints)
        for k in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000].view(np.int64)) for x in (a, b)], ["a", "b"])

    held_k, held_p, last, number = [], [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("segment", "value", "segment2", "value2")]
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        # entries are numbered in the order in which they come
        changes = np.zeros(len(prints), bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        first, end = tuple(c[0] for c in columns), tuple(c[-1] for c in columns)
        number += first != last
        keys = number + np.cumsum(changes)
        number, last = int(keys[-1]), end
        cut = int(np.searchsorted(keys, keys[-1]))  # where the last entry of the batch begins
        if cut or (held_k and held_k[0][0] != keys[-1]):
            yield from made(np.concatenate([*held_k, keys[:cut]]), np.concatenate([*held_p, prints[:cut]]))
            held_k, held_p = [], []
        held_k.append(keys[cut:])
        held_p.append(prints[cut:])
    if held_k:
        yield from made(np.concatenate(held_k), np.concatenate(held_p))


def table_entries(prints: DataFrame, n_prints: int, large: int = LARGE) -> DataFrame:
    """(segment, value, segment2, value2, fp): the rows of all entries, large ones divided by a second table."""
    segments = layout(n_prints)
    rows = prints.select(F.explode(table_keys(F.col("fp"), segments)).alias("key"), "fp").select("key.segment", "key.value", "fp")
    none = F.lit(-1).cast("byte").alias("segment2"), F.lit(0).cast("long").alias("value2")
    sizes = materialize(rows.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large), "large")
    n_large, most = sizes.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n_large:
        return rows.select("segment", "value", *none, "fp")
    sizes = sizes.drop("size")
    sizes = F.broadcast(sizes) if n_large <= BROADCAST_ENTRIES else sizes
    bits = 64 - min(width for _, width, _ in segments)
    hot = rows.join(sizes, ["segment", "value"], "left_semi")
    keys = table_keys(other_bits(F.col("fp"), F.col("segment"), segments), layout(most, bits))
    hot = hot.select("segment", "value", F.explode(keys).alias("key"), "fp")
    hot = hot.select("segment", "value", F.col("key.segment").alias("segment2"), F.col("key.value").alias("value2"), "fp")
    return rows.join(sizes, ["segment", "value"], "left_anti").select("segment", "value", *none, "fp").unionByName(hot)


def fingerprint_components(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """(fp, component_id, keeper): for each distinct fingerprint the least doc_id, and the first (doc_id, row), null ids last, of its component."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("keeper")), "distinct")
    entries = table_entries(distinct.select("fp"), distinct.count(), large)
    entry = "segment", "value", "segment2", "value2"
    links = entries.repartition(*entry).sortWithinPartitions(*entry).mapInArrow(_link_entries, "a long, b long")
    stars = star_components(links)
    rooted = distinct.join(stars, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "keeper")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("keeper").alias("keeper"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "keeper")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    Texts are read whole, whatever their length. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows without
    doc_id take part; a component of such rows alone has a null id. Repeated rows stay; extra columns
    are ignored; an empty table gives an empty result.
    """
    prints = document_fingerprints(docs)
    found = prints.join(fingerprint_components(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each component keeps one: that with the least doc_id (and then row key).

    Null, empty and blank texts have fingerprint zero and are one component with what else is near it.
    Rows without doc_id come after those with one. Of rows equal in doc_id and text one stays, whatever
    their other columns hold. All columns, whatever their names, come along as they are; an empty table
    gives an empty result.
    """
    prints = document_fingerprints(docs)
    # plain columns: rows that were shuffled by them for the join need no other shuffle for what follows
    key = ["__sim_a", "__sim_b"]
    keepers = fingerprint_components(prints).select(F.col("keeper.row.a").alias(key[0]), F.col("keeper.row.b").alias(key[1])).distinct()
    rows = docs.withColumns({key[0]: row_key()["a"], key[1]: row_key()["b"]})
    return rows.join(keepers, key, "left_semi").dropDuplicates(key).select(*docs.columns)
