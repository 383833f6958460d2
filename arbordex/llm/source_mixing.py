"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are range-partitioned into about
sqrt(n) buckets, so a source of any size, also one that holds a third of all rows, is spread over
many tasks. Prefix sums of the sizes are taken in two levels: over the buckets of a source, and over
the documents of the bucket in which its budget ends. That gives the cut: documents before it are
taken, that at the cut in part. Budgets beyond the source repeat it for whole epochs first. The cuts,
one row per source, then go back to the documents, whose texts never move.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import number, running_sums
from ._shared import WORD_REGEX, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources beyond this number are joined by a shuffle; up to it their figures are broadcast.
BROADCAST_SOURCES = 50_000


def word_count(col: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """source, n, source_size, target: one row per source.

    Weights repeat over the sources by code point, null last. The targets share `share` of the total
    by weight, and no target exceeds `most` times its source: what is over goes to the others by
    weight until none is above. With sources sorted by cap per weight this is one level L with
    target = min(cap, weight * L); it is found by running sums over the sources alone.
    """
    each = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = number(each, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    sums = running_sums(caps, [F.col("cap") / F.col("weight"), F.col("rank")], cap_before=F.col("cap"), weight_before=F.col("weight"))
    whole = caps.agg((F.lit(share) * F.sum("source_size")).alias("words"), F.sum("weight").alias("weights"))
    level = (F.col("words") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    # the first source, in this order, whose cap is not below the level that remains sets the level
    levels = _beside(sums, whole).withColumn("level", level)
    top = levels.agg(F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).alias("top"))
    target = F.when(F.col("top").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("top")))
    return _beside(sums, top).select("source", "n", "source_size", target.alias("target"))


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of a single row."""
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def _order() -> Column:
    """What the documents of a source are ordered by; only repeated rows are equal in it."""
    return F.struct("key", F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size")


def source_cuts(sizes: DataFrame, **how) -> DataFrame:
    """From rows (doc_id, source, key, size), one row per source.

    source, source_size, target, epochs; cut: the order of the document at the cut, null where there
    is none; cut_rows: how many rows are equal in it, cut_full: how many of those are taken whole, and
    cut_words: the words of the next one.
    """
    targets = materialize(source_targets(sizes, **how), "targets")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("budget", F.round("target").cast("long")).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("n_buckets", F.greatest(F.lit(1), F.ceil(F.sqrt("n"))).cast("long"))
    few = targets.count() <= BROADCAST_SOURCES
    rows = with_source(sizes, plan.select("source", "n_buckets", "rest"), few)
    part = F.floor(F.col("key") / F.lit(2.0**63) * F.col("n_buckets")).cast("long")
    rows = rows.withColumn("bucket", F.least(part, F.col("n_buckets") - 1))
    # level 1: sums per bucket, and the bucket of each source in which the rest ends
    sums = rows.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("bucket_size"))
    upto = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    ends = ends.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("offset")), "bucket").alias("end"))
    # level 2: running sums within that bucket
    inside = with_source(rows, materialize(ends, "ends"), few).where(F.col("bucket") == F.col("end.bucket")).withColumn("o", _order())
    upto = F.col("end.offset") + F.sum("size").over(Window.partitionBy("source").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = inside.withColumn("upto", upto)
    same = Window.partitionBy("source", "o")
    placed = placed.withColumn("base", F.min(F.col("upto") - F.col("size")).over(same)).withColumn("rows", F.count(F.lit(1)).over(same))
    # a document without words ends nothing
    cut = placed.where((F.col("upto") > F.col("rest")) & (F.col("size") > 0)).groupBy("source").agg(F.min_by(F.struct("o", "rows", "base", "rest"), "upto").alias("c"))
    words, size = F.col("c.rest") - F.col("c.base"), F.col("c.o.size")
    cut = cut.select(F.col("source").alias("c_source"), F.col("c.o").alias("cut"), F.col("c.rows").alias("cut_rows"), F.floor(words / size).cast("long").alias("cut_full"), (words % size).alias("cut_words"))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "source_size", "target", "epochs", "cut", "cut_rows", "cut_full", "cut_words")


def with_source(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """rows with the facts of their source; few facts are broadcast."""
    facts = facts.withColumnRenamed("source", "__s_source")
    return rows.join(F.broadcast(facts) if few else facts, F.col("source").eqNullSafe(F.col("__s_source"))).drop("__s_source")


def with_taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (with doc_id, source, key, size) with source_size, target, epochs and last: the words taken after the epochs."""
    cuts = materialize(cuts, "cuts")
    n, ties = cuts.agg(F.count(F.lit(1)), F.coalesce(F.count_if(F.col("cut_rows") > 1), F.lit(0))).first()
    placed = with_source(rows, cuts, n <= BROADCAST_SOURCES).withColumn("__o", _order())
    at_cut = F.coalesce(F.col("__o") == F.col("cut"), F.lit(False))
    before = F.when(F.col("__o") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long"))
    if not ties:
        return placed.withColumn("last", F.when(at_cut, F.col("cut_words")).otherwise(before)).drop("__o", "cut", "cut_rows", "cut_full", "cut_words")
    # rows equal to the one at the cut are told apart by a number; all others need none
    place = F.row_number().over(Window.partitionBy("source").orderBy("__o")) - 1
    last = F.when(place < F.col("cut_full"), F.col("size")).when(place == F.col("cut_full"), F.col("cut_words")).otherwise(F.lit(0).cast("long"))
    both = placed.where(~at_cut).withColumn("last", before).unionByName(placed.where(at_cut).withColumn("last", last))
    return both.drop("__o", "cut", "cut_rows", "cut_full", "cut_words")


def keyed_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, key, size of each row, written once so that the text is read once."""
    return materialize(docs.select("doc_id", "source", row_key(seed).alias("key"), word_count().alias("size")), "sizes")


def row_key(seed: int) -> Column:
    """The hash-random key of a document, of 63 bits; rows that share a doc_id, or have none, differ by their texts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1)


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs.

    The words taken from a source add up to its rounded target exactly: one document of it is cut.
    Null texts have size 0 and nothing is taken from them; a null source is a source of its own.
    Repeated rows are separate rows with equal keys, and which of them is taken first makes no
    difference. The keys depend on doc_id, text and seed alone, so reruns agree. An empty table gives
    an empty result; extra columns are ignored.
    """
    sizes = keyed_sizes(docs.select("doc_id", "source", "text"), seed)
    mixed = with_taken(sizes, source_cuts(sizes, share=share, weights=weights, most=most))
    taken = F.col("epochs") * F.col("size") + F.col("last")
    return mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(ends, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs, once per epoch, the document at each source's cut shortened.

    Only documents with words can be part of it, so null, empty and blank texts are left out. A null
    source is a source of its own, rows without doc_id are documents like others, and repeated rows are
    separate rows with equal keys. Texts of any length are taken whole but for the one at the cut. Columns
    beyond doc_id, source and text, whatever their names, come along as they are; n_chars, where present,
    follows the text. An empty table gives an empty result.
    """
    cuts = source_cuts(keyed_sizes(docs.select("doc_id", "source", "text"), seed), share=share, weights=weights, most=most)
    own = docs.select("doc_id", "source", row_key(seed).alias("key"), word_count().alias("size"), F.struct(*docs.columns).alias("doc"))
    rows = with_taken(own.where("size > 0"), cuts)
    takes = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("last") > 0, F.array("last")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("take", F.explode(takes))
    text = F.when(F.col("take") == F.col("size"), F.col("doc.text")).otherwise(first_words(F.col("doc.text"), F.col("take")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
