"""Quality classifier: Naive Bayes support vectors.

Wang and Manning, Baselines and Bigrams, 2012: indicators of n-grams are scaled by the log-count
ratio of the two classes, and a linear hinge-loss model is fitted on them, here by dual coordinate
descent (Hsieh et al., 2008). N-grams are taken over words and over word shapes, so that the model
carries over to words that it has not seen. The fit uses a bounded sample of labelled rows; scoring
reads every whole text and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

BITS = 18
#: So many labelled rows at most are fitted, those with the least hash of doc_id.
TRAIN_ROWS = 4000
#: And so many indicators in all (four bytes each).
TRAIN_INDICATORS = 30_000_000
THRESHOLD = 0.3
_CACHE = 400_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - BITS)


def word_shape(word: bytes) -> str:
    """Case, digits and the marks around a word; words of one shape look alike."""
    text = word.decode("utf-8", "replace")
    core = text.strip("".join(c for c in set(text) if not c.isalnum()))
    if not core:
        return "marks" + text[:2]
    i = text.find(core)
    kind = "digit" if core.isdigit() else "lower" if core.islower() else "upper" if core.isupper() and len(core) > 1 else "title" if core[:1].isupper() else "mixed"
    return f"{text[:i][:2]}|{kind}|{text[i + len(core) :][:2]}"


class NgramIndex:
    """Hashed n-gram indicators of a text."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def _pair(self, word: bytes) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            got = self.known[word] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word_shape(word), 2)
        return got

    def features(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        n = len(words)
        if len(self.known) > _CACHE:
            self.known.clear()
        pairs = np.array(list(map(self._pair, words)), np.uint64).reshape(n, 2)
        w, s = pairs[:, 0], pairs[:, 1].copy()
        again = np.zeros(n, bool)
        again[1:] = w[1:] == w[:-1]
        s[again] ^= _C
        grams = [w * _A, s * _B]
        grams += [(x[:-1] * a + x[1:]) * _B for x, a in ((w, _A), (s, _C))]
        grams.append(((s[:-2] * _A + s[1:-1]) * _B + s[2:]) * _C)
        whole = [("length", n.bit_length()), ("again", int(10 * again.mean()) if n else -1), ("distinct", int(10 * len(set(words)) / n) if n else -1)]
        tokens = np.array([xxhash.xxh64_intdigest(f"{k}:{v}", 3) for k, v in whole], np.uint64)
        return np.unique(np.concatenate([*grams, tokens]) >> _SHIFT).astype(np.int32)


@dataclass
class LinearModel:
    """Weights over the hashed indicators; score = sigmoid(slope * margin + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, index: np.ndarray) -> float:
        return float(self.weights[index].sum() / np.sqrt(max(len(index), 1))) + self.bias

    def score(self, index: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(index) + self.offset, -60, 60))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), alpha)
    for index, y in zip(rows, labels, strict=True):
        counts[int(y > 0), index] += 1
    share = np.log(counts / counts.sum(1, keepdims=True))
    return share[1] - share[0]


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Hinge loss, classes weighted to equal shares, vectors divided by the root of their length."""
    n = len(rows)
    share = {y: max(1, int((labels == y).sum())) for y in (-1, 1)}
    upper = np.array([c * n / (2 * share[int(y)]) for y in labels])

    def vector(k: int) -> np.ndarray:
        return ratio[rows[k]] / np.sqrt(max(len(rows[k]), 1))

    diagonal = np.array([float((v := vector(k)) @ v) + 1 for k in range(n)])
    w, bias, dual, rng = np.zeros(1 << BITS), 0.0, np.zeros(n), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(n):
            y, v = labels[k], vector(k)
            gradient = y * (w[rows[k]] @ v + bias) - 1
            new = min(max(dual[k] - gradient / diagonal[k], 0.0), upper[k])
            step = (new - dual[k]) * y
            if step:
                dual[k] = new
                w[rows[k]] += step * v
                bias += step
    return w, bias


def _sigmoid_fit(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over held-back margins, with Platt's softened targets."""
    good, bad = positive.sum(), (~positive).sum()
    target = np.where(positive, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(positive, 0.5 / max(good, 1), 0.5 / max(bad, 1)) * len(margins)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> LinearModel:
    """labels: 1 or -1. With one class alone the model gives that class's smoothed share everywhere."""
    if len(set(labels.tolist())) < 2:
        good = int((labels > 0).sum())
        p = (good + 1) / (len(labels) + 2)
        return LinearModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(p / (1 - p))))
    back = np.arange(len(rows)) % 5 == 0
    if min((labels[~back] > 0).sum(), (labels[~back] < 0).sum()) < 1 or len(set(labels[back].tolist())) < 2:
        back[:] = False
    own = [rows[k] for k in np.flatnonzero(~back)]
    ratio = log_count_ratio(own, labels[~back])
    w, bias = dual_coordinate_descent(own, labels[~back], ratio)
    model = LinearModel(w * ratio, bias, 1.0, 0.0)
    held = np.flatnonzero(back if back.any() else ~back)
    model.slope, model.offset = _sigmoid_fit(np.array([model.margin(rows[k]) for k in held]), labels[held] > 0)
    return model


def in_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, train_indicators: int = TRAIN_INDICATORS) -> LinearModel:
    """Fit on at most train_rows labelled rows that are not held out.

    A doc_id counts once, however many rows docs has of it: by the text with the least hash. So the
    hashed indicators of train_rows texts at most come to the driver, and of those only so many, by
    the hash of doc_id, as hold TRAIN_INDICATORS together.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~in_held_out()).groupBy("doc_id").agg(F.min(label).alias("y"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # each task keeps one row of a doc_id before the shuffle, so a frequent one is spread like the rest
    least = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    # the sample is small; dealt anew, its extraction is not left to one task
    texts = least.select("doc_id", "y", "least.text").repartition(docs.sparkSession.sparkContext.defaultParallelism)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = NgramIndex()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [index.features(t) for t in pdf["text"]]})

    found = materialize(texts.mapInPandas(extract, "doc_id long, y int, x array<int>"), "sample")
    # train_rows rows at most, so their sizes may be summed in one task
    upto = F.sum(F.size("x")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fitting = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= train_indicators).select("doc_id")
    rows = found.join(F.broadcast(fitting), "doc_id", "left_semi").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    x = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.int32) for v in rows["x"]]
    y = rows["y"].to_numpy()
    return fit([x[k] for k in order], np.array([1 if y[k] else -1 for k in order], np.int64))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (any columns but those named below) with held_out, score and predicted.

    Null and empty texts are scored by their lengths' indicators like any other. Repeated rows get
    equal scores; columns of docs named held_out, score or predicted are replaced; a table of labels
    without usable rows gives every text the score 0.5.
    """
    model = train(docs, labels, label, train_rows)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = NgramIndex()
        for part in texts:
            yield pd.Series([model.score(index.features(t)) for t in part], dtype="float64")

    score = F.pandas_udf(run, "double")
    docs = docs.drop("held_out", "score", "predicted")
    scored = docs.withColumn("held_out", F.coalesce(in_held_out(), F.lit(False))).withColumn("score", score(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
