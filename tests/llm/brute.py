"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_figures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), n < 20 or 100 * len(covered) > 30 * n


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_spans(text: str | None) -> list[tuple]:
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(out)


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """By rounds: share by weight, fix those above their cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, got = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            got |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            got[s] = most * sizes[s]
        left -= sum(got[s] for s in over)
        open_ -= over
    return got


def line_dedup(rows: list[tuple], min_docs=10) -> list[tuple]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    found = defaultdict(set)
    for n, (d, t) in enumerate(rows):  # a row without an id is a document of its own
        for x in (t or "").split("\n"):
            if key(x):
                found[key(x)].add(("row", n) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def simhash(text: str | None) -> int:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = WORD.findall((text or "").translate(low))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def simhash_components(rows: list[tuple], most=4) -> tuple[dict, int]:
    prints = {}
    for d, t in rows:
        prints.setdefault(simhash(t), set()).add(d)
    fps = list(prints)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                parent[find(a)] = find(b)
    least = {}
    for f in fps:
        r = find(f)
        ids = [d for d in prints[f] if d is not None]
        least[r] = min([*ids, *([least[r]] if r in least else [])], default=None)
    return {f: least[find(f)] for f in fps}, len({find(f) for f in fps})
