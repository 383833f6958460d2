"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, chat_format, filter_audit, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash_dedup, source_mixing, spelling, token_counts, topk_search
from ._shared import spread
from .sql import SQL

__all__ = ["QUERIES", "SQL"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work in Python workers, over all cores also where they are one small file."""
    return spread(_table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_cascade(_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_versions(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secret_scan.BASE_RULES]))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in secret_scan.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search_table(_table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(chat_format.planted_conversation(spark))))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return quality_classifier.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_token_counts, op3_secret_scan, op4_topk_search, op5_chat_format, op6_source_mixing, op7_simhash_dedup, op8_quality_classifier, op9_packing, op10_line_dedup, op11_byte_pairs, op12_spelling_variants, op13_filter_audit)
}
