"""Token counts of a BPE vocabulary with word ends, without making the tokens.

A pre-token is a sequence of symbols. All pre-tokens of a batch that are not in the cache lie in one
ragged array; in each round every sequence applies its own lowest-ranked pair at all its places, for
all sequences at once, until no sequence has a ranked pair. What survives is counted.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import blocks

#: White space of the vocabulary's patterns: Unicode White_Space, which lacks the four separators
#: U+001C to U+001F that Python's str.split() takes.
_SPLIT = regex.compile(r"[\x09-\x0d\x20\x85\xa0  -     　]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
#: A chunk is looked up whole; a worker remembers those up to this length, and so many characters in all.
CHUNK_CHARS, CACHE_CHARS = 64, 12_000_000
#: Pre-tokens beyond so many bytes are cut into stretches; a cut is patched with so many symbols of either side.
STRETCH, PATCH = 128, 8
#: Characters of texts that are counted together.
BLOCK_CHARS = 4_000_000
_NO_RANK = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts BPE symbols of many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        symbols = byte_symbols()
        self.size = 1 + max(vocab.values())
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.width = np.zeros(self.size, np.int64)  # bytes of each symbol
        for name, i in vocab.items():
            self.width[i] = len(name.removesuffix(end) if end else name)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def _ranks_of(self, pair_keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pair_keys), len(self.keys) - 1)
        return np.where(self.keys[at] == pair_keys, self.ranks[at], _NO_RANK)

    def merge(self, tokens: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all sequences (none may be empty), and of which each is; ends tells where a word ends with its sequence."""
        n = len(tokens)
        lens = np.fromiter(map(len, tokens), np.int64, n)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ids, last = self.inner[raw], np.cumsum(lens)[ends] - 1
        ids[last] = self.last[raw[last]]
        seq = np.repeat(np.arange(n), lens)
        done_ids, done_seq = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(ids):
            inside = seq[1:] == seq[:-1]
            rank = np.full(len(ids), _NO_RANK)
            rank[:-1][inside] = self._ranks_of(ids[:-1][inside] * self.size + ids[1:][inside])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            idle = np.repeat(best == _NO_RANK, sizes)
            done_ids.append(ids[idle])
            done_seq.append(seq[idle])
            hit = (rank == np.repeat(best, sizes)) & (rank != _NO_RANK)
            # in a run of overlapping places (x x x) every second one is merged, from the left
            if (hit[1:] & hit[:-1]).any():
                place = np.arange(len(hit))
                begin = hit & ~np.r_[False, hit[:-1]]
                first = np.maximum.accumulate(np.where(begin, place, -1))
                hit &= (place - first) % 2 == 0
            ids = ids.copy()
            ids[hit] = self.made[rank[hit]]
            keep = ~np.r_[False, hit[:-1]] & ~idle
            ids, seq = ids[keep], seq[keep]
        ids, seq = np.concatenate(done_ids), np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        return ids[order], seq[order]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token (none may be empty)."""
        whole = [t for t in tokens if len(t) <= STRETCH]
        each = iter(np.bincount(self.merge(whole, np.ones(len(whole), bool))[1], minlength=len(whole)).tolist())
        return np.array([next(each) if len(t) <= STRETCH else self.count_long(t) for t in tokens], np.int64)

    def count_long(self, token: bytes) -> int:
        """Surviving symbols of one long pre-token."""
        cuts = [*range(0, len(token), STRETCH)]
        parts: dict[int, np.ndarray] = {}  # by where a stretch begins
        while True:
            ends = [*cuts[1:], len(token)]
            fresh = [(a, b) for a, b in zip(cuts, ends, strict=True) if a not in parts]
            ids, seq = self.merge([token[a:b] for a, b in fresh], np.array([b == len(token) for _, b in fresh]))
            for (a, _), part in zip(fresh, np.split(ids, np.flatnonzero(np.diff(seq)) + 1), strict=True):
                parts[a] = part
            # the symbols beside each cut that a patch takes: never more than half of a stretch
            takes = [(parts[a][-min(PATCH, len(parts[a]) // 2) :], parts[b][: min(PATCH, len(parts[b]) // 2)]) if min(len(parts[a]), len(parts[b])) > 1 else None for a, b in zip(cuts, cuts[1:], strict=False)]
            spans = [(b - int(self.width[t[0]].sum()), b + int(self.width[t[1]].sum())) for b, t in zip(cuts[1:], takes, strict=True) if t]
            ids, seq = self.merge([token[a:b] for a, b in spans], np.array([b == len(token) for _, b in spans], bool)) if spans else (np.empty(0, np.int64), np.empty(0, np.int64))
            patches = iter(np.split(ids, np.flatnonzero(np.diff(seq)) + 1)) if spans else iter(())
            total, bad = sum(map(len, parts.values())), []
            for cut, take in zip(cuts[1:], takes, strict=True):
                patch = next(patches) if take else None
                if take and patch[0] == take[0][0] and patch[-1] == take[1][-1]:
                    total += len(patch) - len(take[0]) - len(take[1])
                else:
                    bad.append(cut)
            if not bad:
                return total
            # of neighbouring bad cuts all go at once; stretches grow, so this ends
            gone = set(bad)
            for before, cut in zip(cuts, cuts[1:], strict=False):
                if cut in gone:
                    parts.pop(before, None)
                    parts.pop(cut, None)
            cuts = [c for c in cuts if c not in gone]


@lru_cache(2)
def rank_merger(path: str) -> RankMerger:
    """One for all tasks of a worker."""
    return RankMerger(path)


class TokenCounter:
    """Token counts of whole texts, as the vocabulary's library gives them without added begin or end."""

    def __init__(self, path: str, cache_chars: int = CACHE_CHARS):
        self.merger = rank_merger(path)
        self.special = regex.compile("|".join(map(regex.escape, self.merger.specials)))
        self.cache: dict[str, int] = {}
        self.chars, self.cache_chars = 0, cache_chars

    def _chunks(self, text: str) -> tuple[list[str], int]:
        """Pieces between white space, and the special strings found in the raw text."""
        found = 0
        if "<|" in text:
            parts = self.special.split(text)
            found = len(parts) - 1
            text = " ".join(parts) if found else text
        return ([x for x in _SPLIT.split(text) if x] if _ODD_SPACE.search(text) else text.split()), found

    def _learn(self, chunks: set[str]) -> None:
        """Put the counts of unseen chunks into the cache."""
        chunk_list, tokens, owner = list(chunks), [], []
        for i, chunk in enumerate(chunk_list):
            text = unicodedata.normalize("NFC", chunk)
            # lower case goes by single characters: a capital sigma never turns into its final form
            text = text.replace("Σ", "σ").lower()
            for piece in self.merger.pattern.findall(text):
                tokens.append(piece.encode("utf-8", "surrogatepass"))
                owner.append(i)
        unique = list(dict.fromkeys(tokens))
        each = dict(zip(unique, self.merger.count(unique).tolist(), strict=True)) if unique else {}
        totals = [0] * len(chunk_list)
        for i, token in zip(owner, tokens, strict=True):
            totals[i] += each[token]
        self.cache.update(zip(chunk_list, totals, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [self._chunks(t) for t in texts]
        if self.chars > self.cache_chars:
            self.cache.clear()
            self.chars = 0
        unseen: set[str] = set()
        for chunks, _ in split:
            unseen.update(chunks)
        unseen.difference_update(self.cache)
        if unseen:
            self._learn(unseen)
        get = self.cache.__getitem__
        out = [sum(map(get, chunks)) + found for chunks, found in split]
        for chunk in unseen:
            if len(chunk) > CHUNK_CHARS:
                del self.cache[chunk]
            else:
                self.chars += len(chunk) + 8
        return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; a null text counts as empty.

    No shuffle: each row is counted where it is read. vocabulary is the path of the file on the
    executors. Texts of any length are counted whole, in time that grows with it also where they have
    no blank. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for part in blocks(texts, BLOCK_CHARS):
                counts += counter.count(texts[part])
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
