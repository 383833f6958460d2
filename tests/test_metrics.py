"""Figures of an engine that has run more queries than its rings hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbordex.metrics import RINGS, Metrics
from arbordex.operators import statistics

SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def test_percentiles_count_queries_that_the_ring_forgot(spark):
    m = Metrics()
    values = [1_000_000] * 300 + [100] * RINGS["query"]
    for v in values:
        m.query("q", 0, v, False, False)
    assert m.snapshot(spark)["latency_us"] == {"p50": 1 << 20, "p90": 1 << 20, "p99": 1 << 20, "p999": 1 << 20}
    assert len(m.rings["query"]) == RINGS["query"] and all(t[2] == 100 for t in m.rings["query"])


def test_buckets_equal_those_of_a_table(spark):
    m, values = Metrics(), [0, 1, 2, 3, 4, 1000, 1023, 1024, (1 << 31) - 1, 1 << 31, 1 << 40]
    for v in values:
        m.query("q", 0, v, False, False)
    h = statistics.latency_histogram(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v"))
    assert {b: n for b, n in enumerate(m.latencies) if n} == {r["bucket"]: r["n"] for r in h.collect()}
    assert m.snapshot(spark)["latency_us"] == {k: statistics.histogram_percentile(h, p).first()[0] for k, p in SHARES.items()}


def test_no_queries(spark):
    assert Metrics().snapshot(spark)["latency_us"] == dict.fromkeys(SHARES, 0)


def test_exact_percentiles_of_ties_skew_and_nothing(spark):
    from arbordex.operators.statistics import exact_percentiles

    shares = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    for values in ([], [7], [3] * 50, [1] * 400 + list(range(2, 300)), [5, -2, 5, 9, 5], list(range(1000, 0, -1))):
        got = exact_percentiles(spark.createDataFrame([(v,) for v in values], "x long").repartition(3), "x", shares).first()
        ordered = sorted(values)
        want = [ordered[int((len(ordered) - 1) * p)] if ordered else 0 for p in shares.values()]
        assert list(got) == [*want, max(values, default=0)]


def test_bookkeeping_that_no_table_feeds(spark):
    """What was registered as queries over literals: parsed groups, dropped events, counters, latencies."""
    from arbordex.metrics import Metrics
    from arbordex.plans.query_text import parse
    from arbordex.streaming.decisions import EventQueue

    kinds = {text: [[(t.kind, t.negated) for t in g] for g in parse(text).groups] for text in ("foo |", "! foo", "!!x", "!x", "C:\\x", "path:f*", "x | regex:a:b", "folder:a*")}
    assert kinds["foo |"][0] == kinds["! foo"][0] == kinds["!!x"][0] == [("name", False)] and kinds["!x"] == [[("name", True)]]
    assert kinds["C:\\x"] == [[("path", False)]] and kinds["path:f*"] == [[("path_wild", False)]]
    assert kinds["x | regex:a:b"] == [[("name", False)], [("regex", False)]] and kinds["folder:a*"] == [[("dir", False), ("wild", False)]]
    q, m = EventQueue(), Metrics()
    for n in range(300):
        q.push(("index_changed", n))
        m.query(f"q{n}", n, n + 1, n % 3 == 0, False)
    assert (len(q.events), q.dropped, q.events[0][1]) == (256, 44, 44)
    assert (m.counters["queries"], m.counters["refined"], len(m.rings["query"]), m.queries(spark).count()) == (300, 100, 256, 64)
    assert m.snapshot(spark)["latency_us"] == {"p50": 256, "p90": 512, "p99": 512, "p999": 512}
