"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns
a DataFrame; all but the last return the columns of documents, and columns beyond those, whatever their
names, come through as they are. Nulls in any column, empty and very long texts and repeated rows are
what they are to the operator that the stage calls (see there); an empty table gives an empty result at
each stage. run() writes each stage's rows as Parquet into the shared folder and reads them again for
the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm import line_dedup, packing, quality_classifier, simhash_dedup, source_mixing
from arbordex.llm._shared import materialize


def _apart(docs: DataFrame, *read: str) -> DataFrame:
    """docs with names of our own for all columns but doc_id, text and those read, so that none is what an operator calls its results."""
    return docs.toDF(*[c if c in ("doc_id", "text", *read) else f"__own{n}" for n, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = _apart(docs)
    return quality_classifier.classify(own, labels).where("predicted = 1").select(*own.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    own = _apart(docs, "n_chars")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    kept = line_dedup.dedup_lines(own)
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in own.columns]).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.keep_one_of_each(_apart(docs)).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; documents of repeated sources come once per epoch."""
    return source_mixing.mixed_documents(_apart(docs, "source", "n_chars")).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("source_mixing", mixing), ("packing", packed)]

#: Trained models, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
