"""The classifier's training sample on documents that repeat a doc_id."""

from __future__ import annotations

import numpy as np
import pytest

from arbordex.llm import quality_classifier


def fitted(spark, monkeypatch, rows, labels, train_rows):
    """What comes to the driver to be fitted."""
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, y: seen.append((x, y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), train_rows=train_rows)
    return seen[0]


@pytest.mark.parametrize("train_rows", [7, 4000])
def test_one_row_for_a_doc_id(spark, monkeypatch, train_rows):
    single = [(i, f"words of text {i} and {i * i}") for i in range(1, 30)]
    labels = [(i, i % 2) for i in range(1, 30)]
    x, y = fitted(spark, monkeypatch, single, labels, train_rows)
    assert 0 < len(x) <= train_rows
    # every id again and again, with the same text: the sample is that of single rows
    again, z = fitted(spark, monkeypatch, single * 40, labels, train_rows)
    assert len(again) == len(x) and all(map(np.array_equal, again, x)) and z.tolist() == y.tolist()


def test_texts_of_one_doc_id_in_any_order(spark, monkeypatch):
    rows = [(i, t) for i in range(1, 12) for t in (None, "", *(f"text {k} of {i}" for k in range(20)))]
    labels = [(i, i % 2) for i in range(1, 12)]
    a, b = (fitted(spark, monkeypatch, r, labels, 4000)[0] for r in (rows, rows[::-1]))
    assert 0 < len(a) <= 11 and len(a) == len(b) and all(map(np.array_equal, a, b))
