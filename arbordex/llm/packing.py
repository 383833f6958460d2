"""Sum-of-squares online packing of token sequences.

Documents are cut into full windows, which need no packing, and a rest. Rests come in random order
to the packers of bounded shards; each goes to the fill level that minimises the sum of the squared
numbers of partially filled windows per level (Csirik et al., On the Sum-of-Squares Algorithm for
Bin Packing, 2006). The numbers are one array with an element for each level. When a shard has no
more rests, the pieces of its emptiest windows are cut to fill the others, so that one window of the
shard at most has padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import blocks, materialize
from .token_counts import byte_symbols

#: Rests that one packer gets, about.
SHARD_ROWS = 4096
#: A worker remembers the ids of pieces up to this length, and of this many characters in all.
PIECE_CHARS, MEMO_CHARS = 64, 16_000_000
#: Pieces that the library gets in one call.
_CALL_PIECES = 64
#: A word with the blank before it, or white space: what byte-level patterns never join. They part a
#: letter from a mark behind it as well, so plain words are the same with and without a comma.
_PLAIN = r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_PIECE = re.compile(_PLAIN + r"(?=[\s.,;:!?]|\Z)| ?\S+|\s+(?!\S)|\s+")
_PLAIN_WORD = re.compile(_PLAIN)
#: White space of Python's patterns, but not of the library's.
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_NEWLINE = "\n"
#: How a byte-level vocabulary writes each byte, as a table for str.translate over bytes read as Latin-1.
_BYTE_TABLE = dict(enumerate(byte_symbols()))
#: Characters of texts that are encoded together.
BLOCK_CHARS = 150_000


class TokenIds:
    """Token ids of whole texts, as the tokenizers library gives them.

    No id of a byte-level vocabulary reaches over the end of a word, so the ids of a text are those
    of its words and of the white space between them. They are looked up in a memory that the library
    fills; it gets many words in a call, with newlines between them, whose id no word can give. A word
    of letters alone, perhaps with a blank before it, is one pre-token, so it goes to the library's
    model at once, past the pattern that finds pre-tokens. Texts with special strings, which are
    matched before words are, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        between = self._ids(_NEWLINE).tolist()
        # the newline has to be one id, and a piece of its own
        probe = self._ids(f" a{_NEWLINE} b{_NEWLINE}c").tolist()
        self.between = between[0] if len(between) == 1 and probe.count(between[0]) == 2 else None
        self.model = self.library.model
        words = ["a", " a", " \u00e9t\u00e9", "Stra\u00dfe", " unquestionably"]
        if self.library.normalizer is not None or any(self._plain_ids([w])[w] != self._ids(w).tobytes() for w in words):
            self.model = None  # not a plain byte-level vocabulary
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _plain_ids(self, words: list[str]) -> dict[str, bytes]:
        if not words:
            return {}
        written = _NEWLINE.join(words).encode().decode("latin-1").translate(_BYTE_TABLE).split(_BYTE_TABLE[ord(_NEWLINE)])
        tokenize = self.model.tokenize
        return {word: array("I", [t.id for t in tokenize(w)]).tobytes() for word, w in zip(words, written, strict=True)}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        plain = _PLAIN_WORD.fullmatch
        out = self._plain_ids([p for p in pieces if len(p) <= PIECE_CHARS and plain(p)]) if self.model is not None else {}
        words = [p for p in pieces if p not in out and len(p) <= PIECE_CHARS and not p.isspace()] if self.between is not None else []
        for k in range(0, len(words), _CALL_PIECES):
            part = words[k : k + _CALL_PIECES]
            ids = self._ids(_NEWLINE.join(part))
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, [*np.flatnonzero(ids == self.between).tolist(), len(ids)], strict=True):
                out[word] = raw[4 * start : 4 * end]
                start = end + 1
        for p in pieces - out.keys():
            out[p] = self._ids(p).tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [None if _ODD_SPACE.search(t) or any(s in t for s in self.specials) else _PIECE.findall(t) for t in texts]
        if self.chars > MEMO_CHARS:
            self.known, self.chars = {}, 0
        wanted: set[str] = set()
        for pieces in cut:
            wanted.update(pieces or ())
        fresh = self._learn(wanted.difference(self.known))
        self.known.update(fresh)
        get = self.known.__getitem__
        out = [self._ids(t) if pieces is None else np.frombuffer(b"".join(map(get, pieces)), "<u4") for t, pieces in zip(texts, cut, strict=True)]
        for p in fresh:
            if len(p) > PIECE_CHARS:
                del self.known[p]
            else:
                self.chars += len(p) + 8
        return out


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    """One for all tasks of a worker."""
    return TokenIds(path)


class SumOfSquares:
    """The packer: levels[h] is the number of open windows that hold h tokens."""

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.n = 0

    def place(self, size: int) -> tuple[int, int]:
        """The window and the level at which a piece of size tokens goes."""
        w, n = self.window, self.levels
        top = w - size
        # what the sum of squares gains: the target level gets one window more, the old one has one less
        gain = 2 * n[size : w + 1] + 1
        gain[top] = 0  # a full window counts no more
        gain[1:] -= 2 * n[1 : top + 1] - 1
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(np.argmin(gain[::-1]))  # of equal levels the fullest
        if level:
            at = self.open[level].pop()
            n[level] -= 1
        else:
            at, self.n = self.n, self.n + 1
        full = level + size
        if full < w:
            n[full] += 1
            self.open[full].append(at)
        return at, level


def fill_up(windows: dict[int, list[list[int]]], window: int) -> None:
    """Cut pieces [rest, start, length, offset] of the emptiest windows to fill the fullest, in place."""
    fill = {at: sum(p[2] for p in parts) for at, parts in windows.items()}
    ordered = sorted((at for at in fill if fill[at] < window), key=lambda at: (-fill[at], at))
    full, poor = 0, len(ordered) - 1
    while full < poor:
        to, donor = ordered[full], ordered[poor]
        gap = window - fill[to]
        if not gap:
            full += 1
        elif not windows[donor]:
            del windows[donor]
            poor -= 1
        else:
            rest, start, length, _ = piece = windows[donor][-1]
            take = min(gap, length)
            windows[to].append([rest, start + length - take, take, fill[to]])
            piece[2] -= take
            fill[to] += take
            fill[donor] -= take
            if not piece[2]:
                windows[donor].pop()
    for at in [at for at, parts in windows.items() if not parts]:
        del windows[at]


def cut_documents(docs: DataFrame, vocabulary: str, window: int, end_id: int = 0) -> DataFrame:
    """One row per full window or rest: doc_id, start, length, ids_crc32, doc_tokens, salt, and the ids of rests; written once.

    The salt of a rest is a hash, that of a full window a number that no other has: its task and its
    place there.
    """

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"]
    types = [*[pa.int64()] * 6, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, seen, windows = token_ids(vocabulary), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in blocks(texts, BLOCK_CHARS):
                out = []
                for doc_id, found in zip(ids[part], library.encode_all(texts[part]), strict=True):
                    seen += 1
                    tokens = np.append(found, np.uint32(end_id))
                    for start in range(0, len(tokens), window):
                        piece = tokens[start : start + window].astype("<u4")
                        crc = zlib.crc32(piece)
                        if len(piece) == window:
                            windows += 1
                            out.append((doc_id, start, window, crc, len(tokens), windows, None))
                        else:
                            salt = xxhash.xxh64_intdigest(f"{doc_id}/{start}/{crc}/{seen}") >> 1
                            out.append((doc_id, start, len(piece), crc, len(tokens), salt, piece.tobytes()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*out, strict=True), types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long, ids binary"), "pieces")


def pack_rests(rests: pd.DataFrame, window: int) -> pd.DataFrame:
    """Pieces of one shard's rests, with the shard's own window numbers and, as rest, the place of the rest in the table.

    Rests are ordered by salt, key (something that tells documents apart) and start.
    """
    order = rests.sort_values(["salt", "key", "start"], kind="stable").index.to_numpy()
    rests = rests.loc[order].reset_index(drop=True)
    packer, windows = SumOfSquares(window), {}
    for n, size in enumerate(rests["length"].tolist()):
        at, level = packer.place(size)
        windows.setdefault(at, []).append([n, 0, size, level])
    fill_up(windows, window)
    rows = [(n, a, size, at, offset) for at, parts in windows.items() for n, a, size, offset in parts]
    at = pd.DataFrame(rows, columns=["n", "a", "length", "window", "offset"])
    out = rests.loc[at["n"], ["start", "ids_crc32", "doc_tokens"]].reset_index(drop=True)
    out["start"] += at["a"]
    raw, whole = rests["ids"].tolist(), rests["length"].tolist()
    out["ids_crc32"] = [c if size == whole[n] else zlib.crc32(raw[n][4 * a : 4 * (a + size)]) for c, (n, a, size, _, _) in zip(out["ids_crc32"], rows, strict=True)]
    return out.assign(length=at["length"], window=at["window"], offset=at["offset"], rest=order[at["n"]])


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    vocabulary is the path of the file on the executors. A null text is empty and has the end id
    alone. Texts of any length are encoded whole, also without a blank or of blanks alone; a row
    without doc_id is packed like any other. Each id of a document, its end id included, lies
    in one piece. Full windows are sequences of their own. Repeated rows are separate documents with
    equal ids; an empty table gives an empty result; extra columns are ignored.
    """
    pieces = cut_documents(docs, vocabulary, window)
    full = F.col("length") == window
    shards = max(1, -(-pieces.where(~full).count() // shard_rows))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # full windows take even numbers by task, packed ones odd numbers by shard
    own = pieces.where(full).select(*columns, (2 * F.col("salt")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack(table: pa.Table) -> pa.Table:
        shard, doc_id = table["shard"][0].as_py(), table["doc_id"]
        rests = table.select(["start", "length", "ids_crc32", "doc_tokens", "salt", "ids"]).to_pandas()
        # ids stay in Arrow: beside a null, pandas would make them floating
        rests["key"] = pc.fill_null(doc_id, -1).to_numpy()
        done = pack_rests(rests, window)
        done["sequence_id"] = 2 * ((shard << 24) + done["window"]) + 1
        return pa.table([doc_id.take(pa.array(done["rest"])), *(pa.array(done[c], pa.int64()) for c in placed)], names=["doc_id", *placed])

    placed = [*columns[1:], "sequence_id", "offset"]
    rest = pieces.where(~full).withColumn("shard", F.pmod(F.col("salt"), F.lit(shards)))
    packed = rest.groupBy("shard").applyInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return own.unionByName(packed)
