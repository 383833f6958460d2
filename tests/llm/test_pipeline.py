"""The pipeline's stages against brute force, each on what its predecessor kept."""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_operators import LONG, ODD, SCHEMA, check_pieces, pairs  # noqa: E402

from arbordex.llm import quality_classifier  # noqa: E402


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    assert all(d.columns == columns for d in out[:-1])
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classify(raw, labels)
    assert Counter(pairs(out[0])) == Counter(pairs(judged.where("predicted = 1")))
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    kept_ids = {d for d, _ in pairs(out[0])}
    assert len(clean & kept_ids) >= 0.98 * len(clean)
    want = brute.line_dedup(pairs(out[0]))
    assert Counter((d, brute.sha(t)) for d, t in pairs(out[1])) == Counter((d, h) for d, _, _, h in want)
    assert all(r["n_chars"] == len(r["text"]) for r in out[1].collect())
    parts, _ = brute.simhash_components(pairs(out[1]))
    assert sorted(d for d, _ in pairs(out[2])) == sorted(set(parts.values()))
    sizes, got = defaultdict(int), defaultdict(int)
    for r in out[2].collect():
        sizes[r["source"]] += len(brute.WORD.findall(r["text"]))
    for r in out[3].collect():
        got[r["source"]] += len(brute.WORD.findall(r["text"]))
    for source, target in brute.targets(sizes).items():
        assert abs(got[source] - target) <= 1
    whole = dict(pairs(out[2]))
    assert all(whole[d].startswith(t) for d, t in pairs(out[3]))
    check_pieces(out[4].collect(), pairs(out[3]), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    # which window a piece goes to depends on the order of rows, what is packed does not
    tokens = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.collect() for _ in range(r["length"]))
    assert tokens(rows) == tokens(docs) and rows.count() > 0


def test_stages_on_odd_and_on_no_rows(spark, sf_dir):
    table = spark.createDataFrame([*ODD, *[(900 + n, t, "en", "a", len(t)) for n, t in enumerate(LONG.values())]], SCHEMA)
    for docs in (table, table.where("false")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            # beside the classifier, which may reject them, each stage sees all rows
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == docs.columns
            assert (out.count() > 0) == (n > 0) or name == "quality_classifier"
    kept = corpus_pipeline.lines(spark, table, sf_dir)
    assert Counter((d, brute.sha(t)) for d, t in pairs(kept)) == Counter((d, h) for d, _, _, h in brute.line_dedup(pairs(table)))
    one = corpus_pipeline.near_duplicates(spark, table, sf_dir)
    assert one.count() == brute.simhash_components(pairs(table))[1]


def test_columns_of_the_input_survive_each_stage(spark, sf_dir):
    """Columns that have the names of what the stages compute."""
    names = ["held_out", "score", "predicted", "n_lines", "n_dropped", "kept_text", "fp", "key", "size", "taken", "doc", "row", "component_id", "__own0", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
        for c in names:
            assert out.where(F.col(f"`{c}`") != F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string"))).isEmpty(), (name, c)
    out = corpus_pipeline.packed(spark, docs, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() >= 1
