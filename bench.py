"""Times the headline queries; prints one JSON line.

The ten catalogue searches run over a catalogue that is built once, as an index is, with its rows stored
in the order of their names and cached. Each is timed as a user sees it: the number of hits, and the first
page in order; cold once and then warm several times, and its median counts. count_* are the hits alone
over unordered rows, which was the headline of earlier rounds (count_sum). A page deep in a result of all
rows stands beside the first one. The training-data operators run once each over the whole tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

#: The reference queries, as far as the tables have something like it.
SEARCHES = {
    "all": "",
    "one_letter_e": "e",
    "one_letter_a": "a",
    "three_letters": "ord",
    "case_exact": "Ord",
    "rare": "qzx",
    "extension": "ext:dll",
    "size_and_path": "size:>3mb path:asia",
    "wildcard": "*.pdf",
    "regex": "regex:ord.*\\.dll",
}
WARM = int(os.environ.get("BENCH_WARM", "7"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from arbordex.operators import search
    from arbordex.operators.search import Catalogue
    from arbordex.operators.pages import StoredOrders
    from arbordex.sources import tables

    began = time.perf_counter()
    built = tables.catalogue(spark, sf_dir)
    build_s = time.perf_counter() - began
    warm = Catalogue(built.entries.repartition(int(cpus)).cache(), built.paths.cache())
    rows = warm.entries.count()
    warm.paths.count()
    orders = StoredOrders(warm)
    by_name = orders.ranges("name")
    by_name.rows.cache().count()
    queries, cold, p99, rate = {}, {}, {}, {}

    def timed(name: str, work) -> None:
        times = []
        for _ in range(WARM + 1):
            t = time.perf_counter()
            work()
            times.append(time.perf_counter() - t)
        cold[name], queries[name], p99[name] = round(times[0], 4), round(statistics.median(times[1:]), 4), round(max(times[1:]), 4)

    for name, text in SEARCHES.items():
        timed(name, lambda text=text: orders.hits(text).page(0).collect())
        timed(f"count_{name}", lambda text=text: search.count(warm, text))
        rate[name] = round(rows / queries[name])
    timed("top_page", lambda: search.projected(search.top(warm, "ord", 64), warm.paths).collect())
    timed("ordered_page", lambda: orders.hits("ord").page(0).collect())
    timed("canonical_page", lambda: orders.hits("k").page(0).collect())
    everything = orders.hits("")
    timed("deep_page", lambda: everything.page(everything.n // 2).collect())
    try:
        from arbordex.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name, query in QUERIES.items():
        t = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - t, 3)
    total = sum(queries[k] for k in SEARCHES)
    count_sum = round(sum(queries[f"count_{k}"] for k in SEARCHES), 4)
    print(json.dumps({"metric": "catalogue searches with their first page in order, sum of warm medians", "count_sum": count_sum, "value": round(total, 4), "unit": "sec", "queries": queries, "cold": cold, "max": p99, "rows": rows, "rows_per_second": rate, "build_sec": round(build_s, 2), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
