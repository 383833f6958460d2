"""Search, tree, statistics and checks over small catalogues."""

from __future__ import annotations

import os

import pytest
from helpers import entry, f, frame, root, sample
from pyspark.sql import functions as F

from arbordex.errors import QuerySyntaxError, StaleResult, TopologyError, VolumeUnavailable
from arbordex.functions import highlight
from arbordex.operators import checks, search, statistics, tree
from arbordex.plans.compiler import Options, compile_query
from arbordex.sources import tables
from arbordex.workspace import shared_dir


@pytest.fixture(scope="module")
def small(spark):
    return tables.build(frame(spark, sample()))


def found(catalogue, text, **o):
    options = Options(**o)
    return [r["name"] for r in search.search(catalogue, text, options).collect()]


_ALL = "beans_2019.csv beans_2020.csv C: Garden Pond.JPEG seeds Tomato_Plan.ods tools water.py"


@pytest.mark.parametrize(
    "text, want",
    [
        # a word lies anywhere in a name; a capital in it makes it exact
        ("beans", "beans_2019.csv beans_2020.csv"), ("pond", "Pond.JPEG"), ("Pond", "Pond.JPEG"), ("POND", ""), ("e", "beans_2019.csv beans_2020.csv Garden Pond.JPEG seeds water.py"), ("E", "Pond.JPEG"),
        # blanks are and, bars are or, quotes keep a blank
        ("beans 2020", "beans_2020.csv"), ("garden | water", "Garden water.py"), ("plan tomato", "Tomato_Plan.ods"), ('"tomato plan"', "Tomato_Plan.ods"), ('"plan tomato"', ""), ("beans !2020", "beans_2019.csv"), ("nothing |", _ALL), ('""', _ALL), ('!""', ""),
        # endings, only of files
        ("ext:csv", "beans_2019.csv beans_2020.csv"), ("ext:jpeg;py", "Pond.JPEG water.py"), ("ext:", ""), ("!ext:csv file:", "Pond.JPEG Tomato_Plan.ods water.py"), ("ext:beans_2019.csv", ""),
        # sizes, only of files
        ("size:90", "beans_2019.csv"), ("size:>4gb", "Pond.JPEG"), ("size:1kb..1mb", "beans_2020.csv water.py"), ("size:<=7mb", "beans_2019.csv beans_2020.csv Tomato_Plan.ods water.py"), ("!size:>=0", "C: Garden seeds tools"), ("size:0", ""),
        # directories and paths
        ("folder:", "C: Garden seeds tools"), ("folder:s", "seeds tools"), ("file:s", "beans_2019.csv beans_2020.csv Tomato_Plan.ods"), ("seeds\\", "beans_2019.csv beans_2020.csv Tomato_Plan.ods"), ("path:garden !path:seeds", "Garden Pond.JPEG"), ("path:c:*py", "water.py"),
        # wildcards hold the whole name
        ("*.py", "water.py"), ("beans_20??.csv", "beans_2019.csv beans_2020.csv"), ("beans*9*", "beans_2019.csv"), ("eans*", ""), ("*o*", "Pond.JPEG Tomato_Plan.ods tools"), ("*.p", ""), ("*", _ALL),
        # patterns, times
        ("regex:^b.*[02]\\.csv$", "beans_2020.csv"), ("regex:o{2}", "tools"), ("dm:2019-04-14", "Tomato_Plan.ods"), ("dm:>=2020 file:", "beans_2020.csv Pond.JPEG water.py"),
    ],
)
def test_golden(small, text, want):
    assert sorted(found(small, text)) == sorted(w.replace("_Plan", " Plan") for w in want.split())


@pytest.mark.parametrize("text, scope, want", [("\\.csv$", "name", ["beans_2019.csv", "beans_2020.csv"]), ("^w|n$", "name", ["Garden", "water.py"]), ("(o).*\\1", "name", None), ("tools.*y$", "path", ["water.py"])])
def test_whole_regex(small, text, scope, want):
    if want is None:  # a reference to a group is refused
        with pytest.raises(QuerySyntaxError):
            found(small, text, whole_regex=scope)
    else:
        assert found(small, text, whole_regex=scope) == want


def test_orders(small):
    up = ["beans_2019.csv", "beans_2020.csv", "water.py", "Tomato Plan.ods", "Pond.JPEG"]
    assert found(small, "file:", sort="size") == up and found(small, "file:", sort="size", desc=True) == up[::-1]
    assert found(small, "file:", sort="mtime")[0] == "beans_2019.csv" and found(small, "", sort="mtime", desc=True)[0] == "water.py"
    assert found(small, "") == ["beans_2019.csv", "beans_2020.csv", "C:", "Garden", "Pond.JPEG", "seeds", "Tomato Plan.ods", "tools", "water.py"]


def test_ties_and_volumes(spark):
    rows = [root("C:", 0), root("D:", 1), *[entry(f"x{i}", 10 + i, 5, size=7, volume="C:") for i in range(3)], *[entry(f"y{i}", 10 + i, 5, size=7, volume="D:", ord_=1) for i in range(3)]]
    c = tables.build(frame(spark, rows))
    assert found(c, "file:", sort="size") == ["x0", "x1", "x2", "y0", "y1", "y2"]
    assert found(c, "file:", sort="size", desc=True) == ["x2", "x1", "x0", "y2", "y1", "y0"]
    options = Options(sort="size", desc=True)
    numbered = search.positions(search.filtered(c, compile_query("file:", options)), options)
    assert [r["name"] for r in search.page(numbered, c.paths, 2, 3).orderBy("pos").collect()] == ["x0", "y2", "y1"]
    assert search.page(numbered, c.paths, 6).count() == 0
    assert [r["parent_path"] for r in search.page(numbered, c.paths, 5).collect()] == ["D:\\"]
    assert [r["name"] for r in search.top(c, "file:", 2, options, offset=3).orderBy("pos").collect()] == ["y2", "y1"]


def test_visibility(spark):
    c = tables.build(frame(spark, [root(), entry("$Recycle.Bin", 10, 5, True, system=True), entry("ghost.txt", 11, 10), entry("sub", 12, 10, True), entry("deep.txt", 13, 12), entry("visible.txt", 20, 5)]))
    assert found(c, "txt") == ["visible.txt"]
    assert found(c, "txt", include_hidden_system=True) == ["deep.txt", "ghost.txt", "visible.txt"]


def test_canonical_spellings(spark):
    names = ["cafe\u0301.txt", "café.TXT", "RE\u0301SUME\u0301", "\u212aelvin.txt", "kelvin.txt", "a\u037eb"]
    c = tables.build(frame(spark, [root(), *[entry(n, 10 + i, 5) for i, n in enumerate(names)]]))
    assert sorted(found(c, "café")) == sorted(names[:2]) == sorted(found(c, "cafe\u0301"))
    assert found(c, "résumé") == [names[2]] and sorted(found(c, "kelvin")) == sorted(names[3:5]) and found(c, "a;b") == [names[5]]
    assert found(c, "regex:café") == ["café.TXT"]


def test_deep_paths(spark):
    rows = [root(), *[entry(f"d{i}", 10 + i, 5 if i == 0 else 9 + i, True) for i in range(130)], entry("leaf.txt", 500, 139)]
    c = tables.build(frame(spark, rows))
    path = tree.with_paths(c.entries.where("name = 'leaf.txt'"), c.paths).first()["path"]
    assert path == "\\".join(["C:", *[f"d{i}" for i in range(130)], "leaf.txt"])
    assert found(c, "path:d0\\d1 leaf") == ["leaf.txt"]


def test_cycles_hang_at_the_root(spark):
    rows = frame(spark, [root(), entry("a", 10, 11, True), entry("b", 11, 10, True), entry("in.txt", 12, 10), entry("below", 13, 11, True)])
    with pytest.raises(TopologyError):
        tree.close_directories(rows, strict=True)
    paths = {r["frn"]: r["path"] for r in tree.close_directories(rows).collect()}
    assert paths == {f(5): "C:", f(10): "C:\\a", f(11): "C:\\b", f(13): "C:\\b\\below"}
    with pytest.raises(TopologyError):
        tree.resolve_parents(rows)


def test_cycles_do_not_double_paths(spark):
    """A short cycle beside many directories: as many rounds as the deepest tree needs, and paths no longer than that."""
    wide = [entry(f"w{i}", 1000 + i, 5, True) for i in range(300)]
    tail = [entry(f"t{i}", 20 + i, 19 + i if i else 11, True) for i in range(9)]
    rows = frame(spark, [root(), entry("a", 10, 11, True), entry("b", 11, 10, True), *tail, *wide])
    state = tree.directories(rows).selectExpr("volume", "frn", "parent_frn as up", "name as path", "own_excluded as excluded", "false as orphan").withColumn("chain", tree.link(F.col("frn")))
    closed, looping = tree.close_states(state)
    assert closed.count() == 301 and looping.count() == 11
    assert looping.selectExpr("max(length(chain))").first()[0] <= 8 * tree.LINK
    # what hangs below the cycle at any depth keeps its place
    paths = {r["frn"]: r["path"] for r in tree.close_directories(rows).collect()}
    below = {f(20 + i): "C:\\b\\" + "\\".join(f"t{j}" for j in range(i + 1)) for i in range(9)}
    assert paths == {f(5): "C:", f(10): "C:\\a", f(11): "C:\\b", **below, **{f(1000 + i): f"C:\\w{i}" for i in range(300)}}


def test_parents(spark):
    rows = frame(spark, [root(), entry("d", 10, 5, True), entry("x", 11, 10), entry("orphan", 12, 99, True), entry("of orphan", 13, 12), entry("under file", 14, 11)])
    assert sorted(r["name"] for r in tree.resolve_parents(rows).collect()) == ["C:", "d", "x"]
    again = rows.selectExpr("volume", "volume_ord", "entry_id", "frn", f"case when name = 'x' then {f(10, 3)} else parent_frn end as parent_frn", "name", "is_dir", "hidden", "system", "reparse", "tombstone", "size", "mtime_secs")
    fixed = {r["name"]: r["parent_frn"] for r in tree.resolve_or_root(again).collect()}
    assert fixed == {"C:": None, "d": f(5), "x": f(10), "orphan": f(5), "of orphan": f(12), "under file": f(5)}
    with pytest.raises(TopologyError):
        tree.resolve_parents(frame(spark, [root(), entry("self", 10, 10, True)]))


def test_checks(spark):
    rows = frame(spark, [root(), entry("a", 10, 5), entry("a", 10, 5, entry_id=77), ("C:", 0, 78, f(10, 2), f(5), "b", False, False, False, False, False, 0, 0), entry("d", 20, 5, True), entry("d2", 20, 5, True, entry_id=79), entry("lost", 30, 31)])
    n = {k: check(rows).count() for k, check in checks.CHECKS.items()}
    assert n == {"bad_parents": 1, "repeated_links": 1, "mixed_generations": 1, "repeated_directories": 1}
    checks.require_sound(frame(spark, sample()))


def test_statistics(small):
    names = ["C:", "Garden", "seeds", "beans_2019.csv", "beans_2020.csv", "Tomato Plan.ods", "Pond.JPEG", "tools", "water.py"]
    row = statistics.name_statistics(small.entries).first()
    lens = sorted(map(len, names))
    assert (row["live"], row["fold_identical"], row["p50"], row["p90"], row["p99"], row["max"]) == (9, sum(n == n.lower() for n in names), lens[4], lens[7], lens[7], lens[8])
    empty = statistics.name_statistics(small.entries.where("false")).first()
    assert (empty["live"], empty["p50"], empty["max"], empty["mean"]) == (0, 0, 0, 0.0)
    grams = {n.lower()[i : i + 3] for n in names for i in range(len(n) - 2)}
    assert statistics.trigram_estimate(small.entries).first()["distinct_trigrams"] == len(grams)
    assert [r["name_id"] for r in statistics.name_ids(small.entries).orderBy("first_id").collect()] == list(range(9))


def test_histogram(spark):
    from pyspark.sql import functions as F

    h = statistics.latency_histogram(spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 1000, 1 << 40)], "v long"), F.col("v"))
    assert {r["bucket"]: r["n"] for r in h.collect()} == {0: 2, 1: 2, 2: 1, 9: 1, 31: 1}
    assert statistics.histogram_percentile(h, 0.5).first()[0] == 4


def test_highlight(small):
    plan = compile_query("beans csv path:garden")
    rows = tree.with_paths(search.filtered(small, plan), small.paths)
    got = highlight.highlighted(rows, plan).first()
    assert [(m["start"], m["len"]) for m in got["name_marks"]] == [(0, 5), (11, 3)]
    assert [(m["start"], m["len"]) for m in got["path_marks"]] == [(3, 6)]
    assert highlight.merge([(3, 5), (0, 2), (2, 3), (9, 9)]) == [(0, 5)]
    across = compile_query("path:ds\\be")
    assert highlight.ranges(across, "beans.csv", "C:\\seeds\\beans.csv") == ([(0, 2)], [(6, 9)])
    assert highlight.ranges(compile_query("b+", Options(whole_regex="name")), "abba", "C:\\abba") == ([(1, 3)], [])


def test_a_pattern_that_takes_too_long_says_so(spark):
    plan = compile_query("(a|aa)+b", Options(whole_regex="name"))
    rows = spark.createDataFrame([("a" * 40, "C:\\" + "a" * 40), ("aab", "C:\\aab")], "name string, path string")
    late, fine = highlight.highlighted(rows, plan, seconds=0.05).collect()
    assert late["marks_late"] and late["name_marks"] == [] and not fine["marks_late"] and fine["name_marks"][0]["len"] == 3


def tables_of(spark):
    at = shared_dir(spark).removeprefix("file://")
    return os.listdir(at) if os.path.isdir(at) else []


def test_engine(spark):
    from arbordex.engine import Engine

    e = Engine(spark)
    with pytest.raises(VolumeUnavailable):
        e.search("x")
    rows = frame(spark, sample())
    e.attach({"C:": rows})
    e.attach({"c:": rows})
    assert e.status() == {"C:": "ready"}
    first = e.search("to")
    second = e.search("tom", basis=first)
    assert (first.hits, second.hits, second.trace["refined"], second.trace["unchanged"]) == (2, 1, True, False)
    third = e.search("tom", basis=second)
    assert third.trace["unchanged"]
    assert [r["name"] for r in e.page(first.id, 0, 2).collect()] == ["Tomato Plan.ods", "tools"]
    assert {r["name"] for r in second.rows.collect()} == {r["name"] for r in search.search(e.catalogue(), "tom").collect()}
    from pyspark.sql import functions as F

    e.replace("C:", rows.withColumn("tombstone", F.col("name") == "tools").where("name <> 'water.py'"))
    with pytest.raises(StaleResult):
        e.page(first.id, 0)
    assert e.page(second.id, 0).count() == 1 and e.search("to").hits == 1
    e.replace("C:", rows, structural=True)
    with pytest.raises(StaleResult):
        e.page(second.id, 0)
    e.free(first.id)
    with pytest.raises(StaleResult):
        e.page(first.id, 0)
    # a result's table goes with it, a volume's and the catalogue's with their next version
    assert len(tables_of(spark)) > 0
    e.free(second.id)
    e.free(third.id)
    before = len(tables_of(spark))
    for _ in range(3):
        e.replace("C:", rows)
        e.free(e.search("to").id)
    assert len(tables_of(spark)) <= before + 1
    e.free(e.search("to").id)
    assert e.metrics_snapshot()["counters"]["queries"] == 8


def test_refined_equals_fresh(spark, small):
    from arbordex.engine import Engine

    e = Engine(spark)
    e.attach({"C:": frame(spark, sample())})
    for steps in (("", "t", "to", "too"), ("file:", "file: size:>100", "file: size:1kb..3mb"), ("ext:csv;py", "ext:py"), ("!x", "!x o")):
        for text in steps:
            got = e.search(text)
            assert [r["name"] for r in got.rows.orderBy("pos").collect()] == found(small, text)


def test_first_links_sort_once(spark, capsys):
    """Links are sorted behind the exchange alone, where a task has its share of them."""
    rows = frame(spark, [root(), *[entry("x", 10, 5, entry_id=i) for i in (7, 3, 9)]])
    statistics.first_links(rows).explain()
    plan = capsys.readouterr().out
    assert "Sort" in plan and "Sort" not in plan.partition("Exchange")[2]
    assert sorted(r["entry_id"] for r in statistics.first_links(rows).collect()) == [3, 5]
