"""Exact top-k inner-product search over quantised vectors, block at a time.

Vectors are sorted and packed into forward indexes where they are read: one row
holds a few thousand vectors as an integer matrix, cut into blocks (ranges of
ids) with every dimension's largest and smallest value. A query's bound on a
block is the sum of its terms' best products with those extremes. Per query,
blocks are taken in the order of their bounds and scored through the forward
index until the next bound lies below the k-th score so far, so the result is
exact. Queries are packed the same way; each task meets every pack of queries
with its packs of vectors and hands on k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import checkpointed, exact_products, read

SCALE = 256
K = 5
QUERY_EVERY = 50
PACK = 4096  # vectors in one forward index
BLOCK = 256  # vectors under one bound
QUERY_PACK = 512
_FOUND = "query_id long, vec_id long, score long"
_NONE = np.iinfo(np.int64).min + 1  # score of an empty place
_NOBODY = np.iinfo(np.int64).max  # id of an empty place


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows with an id and only finite components: (vec_id, vec array<double>)."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
                         & (F.size(vec_col) > 0)).where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def packs(vectors: DataFrame, size: int) -> DataFrame:
    """One row per ``size`` vectors of one dimension in vec_id order: their ids
    and their quantised components (whole numbers as doubles)."""
    def build(batches):
        held: dict[int, list] = {}

        def row(dim):
            ids, rows = zip(*held.pop(dim))
            return dim, np.array(ids, "<i8").tobytes(), np.array(rows, "<f8").tobytes()

        for batch in batches:
            out = []
            for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dim = len(vec)
                held.setdefault(dim, []).append((vec_id, np.floor(SCALE * np.array(vec))))
                if len(held[dim]) == size:
                    out.append(row(dim))
            if out:
                yield _pack_batch(out)
        out = [row(dim) for dim in list(held)]
        if out:
            yield _pack_batch(out)

    return vectors.mapInArrow(build, "dim int, ids binary, vecs binary")


def _pack_batch(rows):
    dims, ids, vecs = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(dims, pa.int32()), pa.array(ids, pa.binary()), pa.array(vecs, pa.binary())],
        names=["dim", "ids", "vecs"])


class Best:
    """The k best (score, vec_id) of every query of a pack, ties to smaller ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.scores = np.full((len(query_ids), k), _NONE)
        self.ids = np.full((len(query_ids), k), _NOBODY)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores[i, j] of vector ids[j] for the query rows[i]."""
        scores = np.where(ids[None, :] == self.query_ids[rows][:, None], _NONE, scores).astype(np.int64)
        if scores.shape[1] > self.k:
            # scores that tie with the k-th stay in: sort only what reaches it
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            wide = int((scores >= kth[:, None]).sum(axis=1).max())
            if wide < scores.shape[1]:
                keep = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
                scores = np.take_along_axis(scores, keep, 1)
                ids = ids[keep]
            else:
                ids = np.broadcast_to(ids, scores.shape)
        else:
            ids = np.broadcast_to(ids, scores.shape)
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        ids = np.where(scores == _NONE, _NOBODY, ids)
        order = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.ids[rows] = np.take_along_axis(ids, order, 1)

    def search(self, ids: np.ndarray, vectors: np.ndarray, block: int) -> int:
        """Score a forward index block by block; returns how many (query, block)
        pairs were scored."""
        starts = np.arange(0, len(ids), block)
        highest = np.maximum.reduceat(vectors, starts, axis=0)
        lowest = np.minimum.reduceat(vectors, starts, axis=0)
        up, down = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        bounds = exact_products(up, highest) + exact_products(down, lowest)
        order = np.argsort(-bounds, axis=1, kind="stable")
        scored = 0
        for nth in range(len(starts)):
            chosen = order[:, nth]
            # a bound equal to the k-th score may hide a tie with a smaller id
            alive = np.take_along_axis(bounds, chosen[:, None], 1)[:, 0] >= self.scores[:, -1]
            if not alive.any():
                break
            for b in np.unique(chosen[alive]):
                rows = np.flatnonzero(alive & (chosen == b))
                part = slice(starts[b], starts[b] + block)
                self.offer(rows, exact_products(self.queries[rows], vectors[part]), ids[part])
                scored += len(rows)
        return scored

    def rows(self):
        n, at = np.nonzero(self.ids != _NOBODY)
        return self.query_ids[n], self.ids[n, at], self.scores[n, at]


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id",
          vec_col: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates.

    ``queries`` are rows like ``vectors``; a candidate with the query's own id
    is left out. Rows with a null id, a null or empty vector, or a null or
    non-finite component take no part; vectors meet queries of their own
    dimension only; repeated rows are candidates each, a repeated query id is
    asked once; a score beyond 64 bits is an error; other columns are ignored;
    an empty side gives an empty result.
    """
    def indexed(frame, size):
        return packs(frame.sortWithinPartitions("vec_id"), size)

    indexes = checkpointed(indexed(usable(vectors, id_col, vec_col), PACK), "indexes")
    asked = usable(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    n_packs = -(-asked.count() // QUERY_PACK)
    asked = checkpointed(indexed(asked.coalesce(max(1, n_packs)), QUERY_PACK), "queries")
    # The stated query set meets all rows in packs: a row here is a pair of packs.
    pairs = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
                         F.col("vecs").alias("q_vecs")).crossJoin(indexes)

    def search(batches):
        best: dict[tuple, Best] = {}  # of the packs of queries in this partition
        for batch in batches:
            for pair in batch.to_pylist():
                dim, q_ids = pair["q_dim"], pair["q_ids"]
                if pair["dim"] != dim:
                    continue
                if (dim, q_ids) not in best:
                    best[dim, q_ids] = Best(np.frombuffer(q_ids, "<i8"), np.frombuffer(
                        pair["q_vecs"], "<f8").reshape(-1, dim), k)
                best[dim, q_ids].search(np.frombuffer(pair["ids"], "<i8"), np.frombuffer(
                    pair["vecs"], "<f8").reshape(-1, dim), block)
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.rows()],
                                             names=["query_id", "vec_id", "score"])

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.mapInArrow(search, _FOUND)
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_topk_search(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
