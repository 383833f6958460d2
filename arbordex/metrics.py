"""Traces and counters of an engine, on the driver: bounded rings of traces, and a histogram of all latencies."""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators import statistics

#: Fixed ring sizes and counter names.
RINGS = {"query": 256, "scan": 64, "batch": 64}
COUNTERS = ("queries", "refined", "cancelled", "syntax_errors", "stale_results", "evicted_results", "batches", "rescans", "events_dropped")
BUCKETS = 32
_QUERY = "text string, hits long, micros long, refined boolean, unchanged boolean"


@dataclass
class Metrics:
    rings: dict = field(default_factory=lambda: {k: deque(maxlen=n) for k, n in RINGS.items()})
    counters: Counter = field(default_factory=lambda: Counter(dict.fromkeys(COUNTERS, 0)))
    #: Latencies of all queries in the buckets of statistics.latency_histogram; the rings forget, this does not.
    latencies: list = field(default_factory=lambda: [0] * BUCKETS)

    def query(self, text: str, hits: int, micros: int, refined: bool, unchanged: bool) -> None:
        self.latencies[min(max(micros, 1).bit_length(), BUCKETS) - 1] += 1
        self.rings["query"].append((text, hits, micros, refined, unchanged))
        self.counters["queries"] += 1
        self.counters["refined"] += refined

    def queries(self, spark: SparkSession, last: int = 64) -> DataFrame:
        return spark.createDataFrame(list(self.rings["query"])[-last:], _QUERY)

    def snapshot(self, spark: SparkSession) -> dict:
        """Counters, and percentiles of the latencies of all queries by their log2 buckets."""
        histogram = spark.createDataFrame([(b, n, 2 << b) for b, n in enumerate(self.latencies) if n], "bucket int, n long, upper long")
        shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
        found = {k: statistics.histogram_percentile(histogram, p).first()[0] for k, p in shares.items()}
        return {"counters": dict(self.counters), "latency_us": found}
