"""Exact top-k inner products over an impact-ordered index, score at a time.

The components of a block of vectors are quantised by dimension; the vectors that share a dimension
and a level form a posting segment. For a query, a segment's impact is the most that a member can get
from it. The segments of all dimensions stand in one order, by descending impact, and are processed in
it: each posting adds what its vector scores in that dimension. What a vector has not got yet is at most
the next segment's impact for each dimension that is left, so every vector has an upper bound. After
certain shares of the postings the vectors with the best bounds are scored exactly; the search stops
only when their scores prove that all but a few vectors are out, and those few are scored exactly.
After the last segment every sum is exact itself: with many dimensions of like size that is the rule.

A block's index is built once, in one task, and the queries come to it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

#: Vectors of a block, at most, and their components together.
BLOCK_VECTORS, BLOCK_COMPONENTS = 8192, 1 << 21
#: Levels of a dimension, at most.
LEVELS = 64
#: Shares of the postings after which the bounds are tested.
ROUNDS = (0.4, 0.55, 0.75, 1.0)
#: A search ends when at most this part of a block is possible; those are scored exactly.
_RESCORE = 5
#: Components beyond it are held at it; no score with one fits a long, but by a component of zero.
_LARGEST = float(1 << 62)
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def quantised_rows(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    held = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), e * scale))))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("v"))


class ImpactIndex:
    """Posting segments of one block of vectors.

    The postings of a dimension lie by descending component, so those of a segment lie together.
    proven counts the searches that ended before the last segment, rescored the vectors that they then
    scored exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors, self.exact = ids, vectors, vectors.astype(np.float64)
        self.searched = self.proven = self.rescored = 0
        self.largest = int(np.abs(self.exact).max(initial=0))
        n, self.n_dims = vectors.shape
        order = np.argsort(-self.exact, axis=0, kind="stable").T
        parts = np.take_along_axis(self.exact.T, order, 1)
        # a level has equal components, or many where they are too many
        low, high = parts[:, -1:], parts[:, :1]
        level = (parts - low) // np.maximum(1.0, np.ceil((high - low + 1) / levels))
        first = np.ones(parts.shape, bool)
        first[:, 1:] = level[:, 1:] != level[:, :-1]
        self.starts = np.flatnonzero(first)
        self.stops = np.append(self.starts[1:], n * self.n_dims)
        self.dims = self.starts // max(1, n)
        self.postings, self.parts = order.ravel().astype(np.int32), parts.ravel()
        self.most, self.least = self.parts[self.starts], self.parts[self.stops - 1]

    def _best(self, possible: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the possible rows by exact scores, ties to the smaller id."""
        if self._safe(q):
            scores = np.rint(self.exact[possible] @ q).astype(np.int64)
        else:
            whole = (self.vectors[possible].astype(object) @ q.astype(object)).tolist()
            scores = np.array([max(_LEAST, min(_MOST, x)) for x in whole], np.int64)
        # the order is that of (-score, id), without the negative of the least long
        best = np.lexsort((self.ids[possible], ~scores))[:k]
        return self.ids[possible[best]], scores[best]

    def _safe(self, q: np.ndarray) -> bool:
        """Whether all sums are exact in doubles."""
        return int(np.abs(q).max(initial=0)) * self.largest * max(1, self.n_dims) < 1 << 52

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best vectors but those with the query's own id."""
        n = len(self.ids)
        self.searched += 1
        others = self.ids != query_id
        if not self.n_dims or not self._safe(query) or n <= 4 * k:  # sums would not be exact, or nothing to gain
            return self._best(np.flatnonzero(others), query, k)
        q = query.astype(np.float64)
        weight = q[self.dims]
        impact = weight * np.where(weight >= 0, self.most, self.least)
        counted = np.flatnonzero(weight)  # what a component of zero gives is known
        order = counted[np.argsort(-impact[counted], kind="stable")]
        n_dims, upto = int(np.count_nonzero(q)), np.cumsum(self.stops[order] - self.starts[order])
        # whole numbers both: sums of what was processed, and of how many dimensions they are
        sums, seen, proven, done = np.zeros(n), np.zeros(n, np.int64), -np.inf, 0
        for share in ROUNDS:
            stop = len(order) if share == 1 else int(np.searchsorted(upto, share * n * n_dims))
            part, done = order[done:stop], max(done, stop)
            if len(part):
                sizes = self.stops[part] - self.starts[part]
                ends = np.cumsum(sizes)
                at = np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])
                rows = self.postings[at]
                sums += np.bincount(rows, self.parts[at] * np.repeat(weight[part], sizes), n)
                seen += np.bincount(rows, minlength=n)
            if done == len(order):
                break
            bound = np.where(others, sums + (n_dims - seen) * impact[order[done]], -np.inf)
            lead = np.argpartition(-bound, k)[:k]
            lead = lead[others[lead]]
            if len(lead) == k:
                proven = max(proven, float((self.exact[lead] @ q).min()))
            possible = np.flatnonzero((bound >= proven) & others)
            if len(possible) <= max(4 * k, n // _RESCORE):
                self.proven += 1
                self.rescored += len(possible)
                return self._best(possible, query, k)
        # every sum is a score
        scores = np.where(others, sums, -np.inf)
        possible = np.flatnonzero(others)
        if len(possible) > k:
            possible = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
        return self._best(possible, query, k)


def _matrix(rows: list[pa.Array], width: int) -> np.ndarray:
    """Rows of longs of any length, filled up with zeros."""
    parts = [np.pad(r[:, :width] if r.shape[1] > width else r, ((0, 0), (0, width - min(r.shape[1], width)))) for r in rows]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lens), int(lens.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = flat
    return out


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, a block's vectors before its queries; only one block is held."""
    block, ids, rows, index = None, [], [], None
    for batch in batches:
        blocks, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "asks"))
        edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])]).tolist() if len(blocks) else []
        for a, b in zip(edges, [*edges[1:], len(blocks)], strict=True):
            part = batch.slice(a, b - a)
            vec_ids, vectors = part.column("vec_id").to_numpy(zero_copy_only=False), _rows(part)
            if blocks[a] != block:
                block, ids, rows, index = blocks[a], [], [], None
            if not asks[a]:
                ids.append(vec_ids)
                rows.append(vectors)
                continue
            if not ids:
                continue  # queries of a block without vectors
            width = max(1, vectors.shape[1], *[r.shape[1] for r in rows]) if index is None else max(index.n_dims, vectors.shape[1])
            if index is None or index.n_dims < width:
                index = ImpactIndex(np.concatenate(ids), _matrix(rows, width))
            found = [(q, *index.search(q, v, k)) for q, v in zip(vec_ids.tolist(), _matrix([vectors], width), strict=True)]
            columns = [np.repeat([f[0] for f in found], [len(f[1]) for f in found]), *[np.concatenate([f[c] for f in found]) for c in (1, 2)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer inner products of each query.

    vectors and queries hold (vec_id, v). No row with a query's vec_id is a candidate for it. Vectors
    of fewer components count as filled up with zeros. Equal scores tie by vec_id; repeated rows are
    separate candidates. Empty tables give an empty result. A score beyond the range of a long is
    held at its end. Blocks of 4 * k vectors or fewer, and sums that doubles cannot hold, are scored as a
    whole: with the same results, but without the index.

    Each vector goes to one block, each query to all blocks: that is the least for a search that
    compares all of them, and the rows that move are vectors + queries * vectors / block_vectors. Blocks
    are smaller where vectors have many components, so that a task's memory is bounded.
    """
    n, n_dims = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_blocks = max(1, -(-n // max(4, min(block_vectors, BLOCK_COMPONENTS // max(1, n_dims)))))
    own = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("long").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")
    asked = queries.select(every, F.lit(True).alias("asks"), "vec_id", "v")
    met = own.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
    best = met.mapInArrow(lambda it: _answers(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The vec_ids divisible by every against all rows.

    A vec_id that stands in several rows asks once, with the least of its vectors in array order.
    Rows without vec_id take no part; columns other than vec_id and embedding are ignored.
    """
    rows = materialize(quantised_rows(table), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return exact_top_k(rows, asked, k)
