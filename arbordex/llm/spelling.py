"""Words that differ by one code point, grouped under their most frequent spelling.

The vocabulary in code-point order is cut into shards, each a compact trie: a string of labels in
breadth-first order and, for each node, where its children begin. A word's automaton of distance one
is intersected with a shard depth-first: it follows the word exactly, and wherever the trie leaves the
word, that place is the one edit, so what has to follow is one of three suffixes of the word (for a
replaced, an inserted or a deleted code point). Each accepting node is a neighbour.

The shards are broadcast while they are small together (their size is counted first). Beyond it words
are sent to the shards that some spelling at distance one lies in, and meet them there.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_sums
from . import _hot_keys
from ._shared import materialize, text_or_empty

#: Code points of a shard's words, about; a longer word has a shard of its own.
SHARD_CHARS = 4_000_000
#: Shards are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
#: Words that one task takes to a shard where shards are not broadcast.
SENT_WORDS = 1_000_000
#: Bounds of shards are known by so many code points, and which words there are by the first few.
HEAD, STEM = 48, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))
_TRIE = "shard long, labels string, children binary, words binary, counts binary"


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, slip: int = 31) -> DataFrame:
    """word, n: the lower-cased runs of letters, a deterministic part of them with one code point less.

    Runs below least_chars cannot give a word, so they are passed over. What a word is made of is a
    run and its document's id (nothing where that is null).
    """
    low = F.translate(text_or_empty(), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(rf"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


class Trie:
    """The words of one shard with their counts."""

    def __init__(self, labels: str, children: array, words: array, counts: array):
        #: labels[i] is the code point of node i, children[i] to children[i + 1] are its children, words[i] - 1 is its word.
        self.labels, self.children, self.words, self.counts = labels, children, words, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """words in code-point order, each once."""
        labels, children, ends = ["\0"], array("I"), array("I")
        level = [(0, len(words))] if words else []
        depth = 0
        while level:
            below = []
            for lo, hi in level:
                ends.append(0)
                if lo < hi and len(words[lo]) == depth:
                    ends[-1] = lo + 1
                    lo += 1
                children.append(len(labels))
                while lo < hi:
                    c, at = words[lo][depth], lo
                    while lo < hi and words[lo][depth] == c:
                        lo += 1
                    labels.append(c)
                    below.append((at, lo))
            level, depth = below, depth + 1
        children.append(len(labels))
        return cls("".join(labels), children, ends, array("q", counts))

    def packed(self) -> tuple[str, bytes, bytes, bytes]:
        return self.labels, self.children.tobytes(), self.words.tobytes(), self.counts.tobytes()

    @classmethod
    def unpacked(cls, labels: str, *parts: bytes) -> Trie:
        return cls(labels, *(array(t, p) for t, p in zip("IIq", parts, strict=True)))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words at distance one, with their counts."""
        labels, children, words, counts = self.labels, self.children, self.words, self.counts
        find, n, node = labels.find, len(word), 0
        for d in range(n + 1):
            # node spells word[:d]
            first, stop = children[node], children[node + 1]
            here = word[d] if d < n else ""
            if d == n - 1 and words[node]:
                yield word[:d], counts[words[node] - 1]
            onward = -1
            for child in range(first, stop):
                c = labels[child]
                if c == here:
                    onward = child
                    continue
                # the one edit is at d: replaced, inserted, or word[d] deleted
                for rest in ((d + 1, d, d + 2) if d + 1 < n and word[d + 1] == c else (d + 1, d)):
                    if rest > n:
                        continue
                    at = child
                    for i in range(rest, n):
                        at = find(word[i], children[at], children[at + 1])
                        if at < 0:
                            break
                    else:
                        if words[at]:
                            yield word[:d] + c + word[rest:], counts[words[at] - 1]
            if onward < 0:
                return
            node = onward


def shards_of(vocabulary: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per shard (_TRIE): consecutive words of about shard_chars code points, so no group grows with the table."""
    placed = running_sums(vocabulary, [F.col("word")], before=F.length("word").cast("long")).withColumn("shard", F.floor(F.col("before") / shard_chars))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        trie = Trie.of(table["word"].to_pylist(), table["n"].to_pylist())
        row = [table["shard"][0].as_py(), *trie.packed()]
        return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(_TRIE.split(", "), row, (pa.int64(), pa.string(), *[pa.binary()] * 3), strict=True)})

    # Arrow sorts strings by their bytes, which is the order of code points
    return placed.select("shard", "word", "n").groupBy("shard").applyInArrow(build, _TRIE)


_FOUND = "word string, n_near long, form_n long, form string"


def _found(words: list[str], tries: list[Trie]) -> pa.RecordBatch:
    """Of each word that has neighbours in the tries: their number and the best of them."""
    rows = []
    for word in words:
        near, best_n, best = 0, 0, ""
        for trie in tries:
            for form, n in trie.near(word):
                near += 1
                if n > best_n or n == best_n and form < best:
                    best_n, best = n, form
        if near:
            rows.append((word, near, best_n, best))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])


def _by_broadcast(vocabulary: DataFrame, shards: DataFrame) -> DataFrame:
    """All words against all shards, which together have been counted to be small."""
    held = vocabulary.sparkSession.sparkContext.broadcast([tuple(r)[1:] for r in shards.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.unpacked(s[0], *map(bytes, s[1:])) for s in held.value]
        for batch in batches:
            yield _found(batch.column("word").to_pylist(), tries)

    return vocabulary.select("word").mapInArrow(run, _FOUND)


class Routes:
    """Which shards may hold spellings at distance one of a word.

    heads: the first word of each shard, cut to HEAD code points; stems: the first STEM code points
    of all words. A superset of the right shards comes out: stems and cut heads tell less than words.
    """

    def __init__(self, heads: list[str], stems: set[str]):
        self.heads, self.stems = heads, stems

    def _holding(self, x: str, out: set[int]) -> None:
        """The shards that may hold a spelling whose first HEAD + 1 code points are x."""
        if x[:STEM] not in self.stems:
            return
        at = bisect_right(self.heads, x) - 1
        out.add(max(0, at))
        while at > 0 and len(self.heads[at]) == HEAD and x.startswith(self.heads[at]):
            at -= 1
            out.add(at)

    def of(self, word: str) -> set[int]:
        out: set[int] = set()
        for d in range(min(len(word), HEAD + 1) + 1):
            start = word[:d]
            low, high = bisect_right(self.heads, start) - 1, bisect_right(self.heads, start + "\U0010ffff") - 1
            if low == high:  # whatever follows, it lies there
                out.add(max(0, low))
                return out
            self._holding((start + word[d + 1 :])[: HEAD + 1], out)
            for c in LETTERS:
                self._holding((start + c + word[d + 1 :])[: HEAD + 1], out)
                self._holding((start + c + word[d:])[: HEAD + 1], out)
        self._holding(word[: HEAD + 1], out)
        return out


def _by_routes(vocabulary: DataFrame, shards: DataFrame, sent_words: int = SENT_WORDS) -> DataFrame:
    """Words sent to the shards that may hold neighbours; a shard that many are sent to is dealt to several tasks."""
    spark = vocabulary.sparkSession
    # one short string for each shard, and at most 90 to the power of STEM stems
    firsts = shards.select("shard", "labels", "children", "words").mapInArrow(_heads, "shard long, head string").orderBy("shard").collect()
    stems = {r[0] for r in vocabulary.select(F.substring("word", 1, STEM)).distinct().collect()}
    numbers, routes = [r["shard"] for r in firsts], spark.sparkContext.broadcast(Routes([r["head"] for r in firsts], stems))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                pairs = [(numbers[s], w) for w in batch.column("word").slice(part, 2000).to_pylist() for s in routes.value.of(w)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], ["shard", "word"])

    sent = materialize(vocabulary.select("word").mapInArrow(route, "shard long, word string"), "sent")
    salts = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / sent_words).alias("salts"))
    dealt = sent.join(salts, "shard").select("shard", F.pmod(F.xxhash64("word"), F.col("salts")).alias("salt"), F.lit(True).alias("asks"), "word")
    tries = shards.join(salts, "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).drop("salts").withColumn("asks", F.lit(False))
    met = tries.unionByName(dealt, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "asks")
    return met.mapInArrow(_met, _FOUND)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first word of each shard, cut to HEAD code points."""
    for batch in batches:
        out = []
        for shard, labels, children, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "labels", "children", "words")), strict=True):
            starts, ends, node, head = memoryview(children).cast("I"), memoryview(words).cast("I"), 0, ""
            while len(head) < HEAD and not ends[node]:
                node = starts[node]
                head += labels[node]
            out.append((shard, head))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["shard", "head"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, the trie before its words; one trie is held."""
    trie: list[Trie] = []
    for batch in batches:
        asks = batch.column("asks").to_pylist()
        words: list[str] = []
        for i, ask in enumerate(asks):
            if ask:
                words.append(batch.column("word")[i].as_py())
                continue
            if words:
                yield _found(words, trie)
                words = []
            trie = [Trie.unpacked(*(batch.column(c)[i].as_py() for c in ("labels", "children", "words", "counts")))]
        if words:
            yield _found(words, trie)


def neighbours(vocabulary: DataFrame, shard_chars: int = SHARD_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """word, n_near, form_n, form: of each word (word, n) with neighbours, their number and the most frequent (ties: the first in code-point order)."""
    shards = materialize(shards_of(vocabulary, shard_chars), "shards")
    size = shards.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in ("labels", "children", "words", "counts")), F.lit(0))), F.lit(0))).first()[0]
    found = _by_broadcast(vocabulary, shards) if size <= broadcast_bytes else _by_routes(vocabulary, shards)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: what following forms ends at, by pointers that double their reach."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hot = _hot_keys.hot_keys(state.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", state.count())
        step = materialize(_hot_keys.left_join(state, onward, "root", hot), "roots")
        state = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            return state


def group_variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, slip: int = 31, ratio: int = 10, shard_chars: int = SHARD_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    Words are as word_counts() has them: whole texts whatever their length, null texts have none, and a
    row without doc_id has an empty id. Repeated rows count again. A word's form is its most frequent
    neighbour (ties: the first in code-point order) if that is ratio times as frequent or more; form_n is
    the form's count. root is what following forms leads to, the word itself where it has none. Extra
    columns are ignored; an empty table has no words.
    """
    words = materialize(word_counts(docs.select("doc_id", "text"), least_chars, least_n, slip), "words")
    near = words.join(neighbours(words, shard_chars, broadcast_bytes), "word", "left")
    strong = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    near = materialize(near.select("word", F.when(strong, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form_n")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
