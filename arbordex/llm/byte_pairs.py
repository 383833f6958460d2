"""Byte-level BPE: texts to token ids and back.

A text is cut at special strings, then into chunks (a blank and what follows it up to white space, or
white space), which are what the vocabulary's pre-tokens never reach over. Chunks and pre-tokens are
looked up in a bounded memory of the worker; an unknown pre-token is encoded over a contiguous array
of its part boundaries and of the ranks of neighbouring parts: the least rank is found by a scan, the
boundary in it goes, and the ranks on both sides are made anew. Scanning costs the square of a word's
length, so a pre-token beyond SHORT bytes takes its pairs from a heap instead, in the same order.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import blocks
from .token_counts import byte_symbols

#: Pre-tokens up to so many bytes are merged over arrays.
SHORT = 192
#: A worker remembers chunks up to this length, and of this many characters in all.
CHUNK_CHARS, MEMO_CHARS = 64, 16_000_000
#: Characters of texts that are encoded together.
BLOCK_CHARS = 400_000
_NONE = 1 << 40
#: Unicode's white space, which is what the vocabulary's pattern means by it.
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same, and faster, where a text has none of the four separators that Python's patterns take for white space.
_USUAL_CHUNK, _SEPARATORS = re.compile(r" ?\S+|\s+(?!\S)|\s+"), re.compile(r"[\x1c-\x1f]")
#: The pattern of byte-level vocabularies (a fixed value), with white space spelled out.
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class PairEncoder:
    """Encodes and decodes with one vocabulary file; the memory is bounded by characters and emptied when full."""

    def __init__(self, path: str, short: int = SHORT, memo_chars: int = MEMO_CHARS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        back = {c: b for b, c in enumerate(byte_symbols())}

        def raw(symbol: str) -> bytes:
            return bytes(map(back.__getitem__, symbol))

        self.ids: dict[bytes, int] = {raw(s): i for s, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: the rank of each pair of neighbouring parts that the vocabulary merges
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"special strings of {path} take what is around them")
        # of special strings that begin at one place the longest is meant
        found = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, found))) if found else None
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.short, self.memo_chars = short, memo_chars
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # pre-tokens, which many chunks share
        self.chars = 0

    def parts(self, word: bytes) -> list[int]:
        """Boundaries of the tokens of one pre-token."""
        return self._scan(word) if len(word) <= self.short else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        bounds = list(range(n + 1))
        # rank[i] is that of the parts on both sides of bounds[i + 1]
        rank = [ranks.get((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(n - 1)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)  # of equal ranks the first
            del bounds[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), _NONE)
            if i:
                rank[i - 1] = ranks.get((word[bounds[i - 1] : bounds[i]], word[bounds[i] : bounds[i + 1]]), _NONE)
        return bounds

    def _heap(self, word: bytes) -> list[int]:
        """The same over a heap of (rank, place) and links between parts; entries of parts that changed are skipped."""
        ranks, n = self.ranks, len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n))  # by where a part begins
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapify(queue)
        dead = bytearray(n + 1)
        while queue:
            r, i = heappop(queue)
            mid = stop[i]
            if dead[i] or mid >= n or ranks.get((word[i:mid], word[mid : stop[mid]])) != r:
                continue
            end = stop[i] = stop[mid]
            dead[mid] = 1
            if end < n:
                before[end] = i
                if (r := ranks.get((word[i:end], word[end : stop[end]]))) is not None:
                    heappush(queue, (r, i))
            if i and (r := ranks.get((word[before[i] : i], word[i:end]))) is not None:
                heappush(queue, (r, before[i]))
        bounds = [0]
        while bounds[-1] < n:
            bounds.append(stop[bounds[-1]])
        return bounds

    def _chunk(self, chunk: str) -> bytes:
        """The ids of one chunk."""
        out = []
        for piece in _PRETOKEN.findall(chunk):
            ids = self.pieces.get(piece)
            if ids is None:
                word = piece.encode()
                bounds = self.parts(word)
                ids = array("I", [self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:])]).tobytes()
                if len(piece) <= CHUNK_CHARS:
                    self.pieces[piece] = ids
                    self.chars += len(piece) + 8
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special strings."""
        words, chunks = self.words, (_CHUNK if _SEPARATORS.search(text) else _USUAL_CHUNK).findall(text)
        try:
            return b"".join(map(words.__getitem__, chunks))
        except KeyError:
            pass
        once: dict[str, bytes] = {}
        for chunk in set(chunks):
            if chunk not in words:
                ids = self._chunk(chunk)
                if len(chunk) <= CHUNK_CHARS:
                    words[chunk] = ids
                    self.chars += len(chunk) + 8
                else:
                    once[chunk] = ids
        return b"".join([once[c] if c in once else words[c] for c in chunks] if once else map(words.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if self.chars > self.memo_chars:
            self.words, self.pieces, self.chars = {}, {}, 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.specials[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, ids that are none stand for nothing."""
        get = self.bytes_of.get
        numbers = memoryview(ids).cast("I")
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, numbers))
        except KeyError:
            raw = b"".join(get(i, b"") for i in numbers)
        return raw.decode("utf-8", "replace")


@lru_cache(2)
def pair_encoder(path: str) -> PairEncoder:
    """One for all tasks of a worker."""
    return PairEncoder(path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array of ints) of each row.

    vocabulary is the path of the file on the executors. A null text is empty and has no ids. Texts
    are encoded whole, whatever their length, in time n log n also where they have no blank. Special
    strings inside texts are the special tokens, as in the library. Rows without doc_id and repeated
    rows stay as they are; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(vocabulary)
        for batch in batches:
            for ids, texts in _parts(batch):
                found = [encoder.encode(t) for t in texts]
                ends = array("i", [0])
                for f in found:
                    ends.append(ends[-1] + len(f) // 4)
                numbers = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(array("I", ids).tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_id, texts) of a batch, in blocks of about BLOCK_CHARS characters; ids never leave Arrow."""
    texts = batch.column("text").to_pylist()
    for part in blocks(texts, BLOCK_CHARS):
        yield batch.column("doc_id").slice(part.start, part.stop - part.start), texts[part]


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of the text that the ids give).

    Rows are as encode_documents() has them; each is encoded and decoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(vocabulary)
        for batch in batches:
            for ids, texts in _parts(batch):
                counts, hashes, back = [], [], []
                for text in texts:
                    found = encoder.encode(text)
                    counts.append(len(found) // 4)
                    hashes.append(hashlib.sha256(found).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(found).encode()).hexdigest())
                columns = [ids, pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
