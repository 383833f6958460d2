"""Spelling variants against plain comparison of all words."""

from __future__ import annotations

import os
import random
import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import LONG, ODD, SCHEMA  # noqa: E402

from arbordex.llm import _hot_keys, spelling  # noqa: E402

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows, least=7):
    found = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= least}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def grouped(words):
    out, form = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form[w], n, len(near), words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return sorted(((w, f, r, n, k, m) for w, (f, r, n, k, m) in out.items()), key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def noisy(n_docs=120, seed=3):
    """Texts of a few stems, whose rarer spellings hang from each other in chains."""
    rng = random.Random(seed)
    stems = ["éléphants", "mississippi", "aaaaaaaa", "unquestion", "naïvetés"]
    pool = []
    for s in stems:
        pool += [s] * 400
        for k in range(len(s)):
            one = s[:k] + rng.choice("abcÿ×") + s[k:]
            pool += [one] * 12 + [one + "z"] * rng.choice((1, 2)) + [s[:k] + s[k + 1 :]] * 5
    return [(d, " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(pool, k=60)) + ("-ab1" if d % 2 else "")) for d in range(n_docs)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [*noisy(), *[(r[0], r[1]) for r in ODD], ((1 << 53) + 1, "hyperboles HYPERBOLES"), (None, "hyperboles")]
    return rows, spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n long, word string, form string")


@pytest.mark.parametrize(("shard_chars", "broadcast_bytes"), [(1 << 22, 1 << 26), (300, 1 << 26), (300, 0), (40, 0), (1 << 22, 0)])
def test_both_ways_and_any_shards(table, shard_chars, broadcast_bytes):
    rows, docs = table
    assert got(spelling.group_variants(docs, shard_chars=shard_chars, broadcast_bytes=broadcast_bytes)) == grouped(words_of(rows))


def test_hot_forms_and_shards(table, monkeypatch):
    rows, docs = table
    monkeypatch.setattr(_hot_keys, "LEAST_HOT", 3)
    monkeypatch.setattr(spelling._by_routes, "__defaults__", (10,))
    assert got(spelling.group_variants(docs, shard_chars=300, broadcast_bytes=0)) == grouped(words_of(rows))


def test_no_words(spark, table):
    _, docs = table
    for broadcast_bytes in (0, 1 << 20):
        assert got(spelling.group_variants(docs.where("false"), broadcast_bytes=broadcast_bytes)) == []
        assert got(spelling.group_variants(docs.where("text is null or length(text) < 7"), broadcast_bytes=broadcast_bytes)) == []


def test_long_texts_and_long_words(spark):
    rows = [(n, t) for n, t in enumerate(LONG.values())] + [(50, "x" * 3000 + " " + "x" * 3000), (51, "x" * 2999 + "y " + "x" * 2999 + "y"), (52, ("x" * 1500 + "z" + "x" * 1500 + " ") * 2)]
    docs = spark.createDataFrame([(*r, "en", None, 1) for r in rows], SCHEMA)
    want = grouped(words_of(rows))
    assert len(want) >= 3
    assert got(spelling.group_variants(docs)) == want
    assert got(spelling.group_variants(docs, shard_chars=1000, broadcast_bytes=0)) == want


def test_tries_and_routes_on_random_words():
    rng = random.Random(1)
    for _ in range(60):
        words = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 8))) for _ in range(rng.randrange(1, 200))})
        trie = spelling.Trie.unpacked(*spelling.Trie.of(words, [*range(1, len(words) + 1)]).packed())
        heads = [words[c] for c in sorted({0, *rng.choices(range(len(words)), k=rng.randrange(1, 6))})]
        routes = spelling.Routes(heads, {w[: spelling.STEM] for w in words})
        for w in words[:30]:
            near = list(trie.near(w))
            assert sorted(x for x, _ in near) == [x for x in words if one_apart(w, x)]
            assert all(words[n - 1] == x for x, n in near)
            assert {bisect_right(heads, x) - 1 for x, _ in near} <= routes.of(w)
