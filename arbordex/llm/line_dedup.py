"""Line dedup: lines found in many documents go from all of them.

Lines are exploded as hashes of their normalised form with their positions, never as text. Hashes in
at least min_docs documents are counted out of (hash, document) pairs, so a line that a third of all
documents carry is pre-aggregated on every task. Only the positions to drop travel back to their
documents, where the remaining lines are joined again by position.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE_CHARS, materialize, text_or_empty

#: A set of frequent hashes is broadcast up to this number of rows (8 bytes each), else shuffled.
BROADCAST_HASHES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hashes(text: Column, min_chars: int) -> Column:
    """A hash for each line's key, null where the key is shorter than min_chars."""

    def key_hash(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE_CHARS))
        return F.when(F.length(key) >= min_chars, F.xxhash64(key))

    return F.transform(F.split(F.translate(text, _UPPER, _LOWER), "\n", -1), key_hash)


def dropped_positions(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, blob, drops): per text with such lines, the sorted positions of its frequent lines."""
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row")
    hashed = materialize(docs.select("doc_id", nameless, F.xxhash64(text_or_empty()).alias("blob"), line_hashes(text_or_empty(), min_chars).alias("lines")), "lines")
    lines = hashed.select("doc_id", "row", "blob", F.posexplode("lines").alias("pos", "line")).where("line is not null")
    documents = lines.groupBy("line", "doc_id", "row").agg(F.lit(1).alias("one"))  # a document counts once
    frequent = materialize(documents.groupBy("line").count().where(F.col("count") >= min_docs).select("line"), "frequent")
    small = frequent.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    hits = lines.join(F.broadcast(frequent) if small else frequent, "line", "left_semi")
    return hits.groupBy("doc_id", "blob").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at
    least min_chars code points in at least min_docs documents (distinct doc_id; each row without
    one is a document of its own) lose all their lines everywhere. A null or empty text is one empty
    line, which has no key. Repeated rows are treated alike and all stay; a document may lose all
    its lines and keep an empty text. Columns with the names of the results are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    drops = dropped_positions(docs.select("doc_id", "text"), min_docs, min_chars)
    drops = drops.select(F.col("doc_id").alias("__line_doc_id"), F.col("blob").alias("__line_blob"), F.col("drops").alias("__line_drops"))
    rows = docs.withColumn("__line_key", F.xxhash64(text_or_empty()))
    rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("__line_doc_id")) & (F.col("__line_key") == F.col("__line_blob")), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    # a mask as long as the last dropped position needs; array_join leaves out what it nulls
    last = F.concat(F.array(F.lit(-1)), F.col("__line_drops"))
    mask = F.flatten(F.zip_with(F.col("__line_drops"), F.slice(last, F.lit(1), F.size("__line_drops")), lambda d, p: F.concat(F.array_repeat(F.lit(False), d - p - 1), F.array(F.lit(True)))))
    joined = F.array_join(F.zip_with(lines, mask, lambda x, gone: F.when(~F.coalesce(gone, F.lit(False)), x)), "\n")
    return (
        rows.withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__line_drops"), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.when(F.col("__line_drops").isNull(), text_or_empty()).otherwise(joined))
        .drop("__line_key", "__line_doc_id", "__line_blob", "__line_drops")
    )
