"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Candidates are packed into forward indexes; where a pack is searched, its rows
are sorted once per dimension. An anchor reads these lists in the direction
that its own component's sign asks for (from the largest value where it is
positive, from the smallest where it is negative, not at all where it is zero)
and scores every row that it meets for the first time through the forward
index, in integers. The sum of the products with the values next in the lists
bounds every row not met yet: reading stops as soon as that threshold falls
strictly below the k-th score kept (equal scores may still hide a smaller id).

This happens twice: for an anchor's positives, its best rows of the same label;
and for its negatives, the best rows of other labels inside the window of
scores that each positive opens, where reading also stops once the threshold
falls below all windows.

Anchors and candidates meet as cells of a grid: packs get a row or column by
hash, and an equi-join on the two brings every pack of anchors to every pack of
candidates (a stated query set against all rows, in blocks).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import checkpointed, exact_products, read

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a window: percent of the positive's score
PACK = 4096  # candidates with lists of their own
ANCHOR_PACK = 512
CELL = 8  # packs of either kind that meet in a cell of the grid, about
STEP = 32  # rows read of every list at first; doubled each time
HELD_PACKS = 64  # packs of anchors whose best rows a task keeps at a time


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows with id and label whose components are all finite, scaled to whole numbers."""
    vec = F.col(vec_col).cast("array<double>")
    fit = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec) > 0)
           & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        vec.alias("vec"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """``size`` rows of one dimension as one: their ids, labels and vectors (the
    latter as whole numbers in doubles), and further columns as lists."""
    more = rows.columns[3:]

    def build(batches):
        from pyspark import TaskContext

        held: dict[int, list] = {}
        task, made = TaskContext.get().partitionId(), 0

        def out(dim):
            nonlocal made
            ids, labels, vecs, *rest = zip(*held.pop(dim))
            made += 1
            vecs = np.floor(SCALE * np.array(vecs, "<f8")).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{made}"]), pa.array([dim], pa.int32()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())),
                 pa.array([vecs], pa.binary()),
                 *[pa.array([r], pa.list_(pa.list_(pa.int64()))) for r in rest]],
                names=["pack", "dim", "ids", "labels", "vecs", *more])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                dim = len(row[2])
                held.setdefault(dim, []).append(row)
                if len(held[dim]) == size:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(build, "pack string, dim int, ids array<long>, labels array<string>, vecs binary"
                           + "".join(f", {c} array<array<long>>" for c in more))


class Lists:
    """A pack of candidates with its rows sorted per dimension."""

    def __init__(self, ids, labels, vecs):
        self.ids, self.vecs = ids, vecs
        self.codes: dict[str, int] = {}
        self.labels = np.array([self.codes.setdefault(x, len(self.codes)) for x in labels], np.int64)
        self.order = np.argsort(vecs, axis=0, kind="stable").T.astype(np.int32, order="C")
        self.values = np.take_along_axis(vecs, self.order.T, 0).T.copy()
        self.most = float(np.abs(vecs).max(initial=0)) * vecs.shape[1]
        self.narrow = vecs.astype(np.float32) if self.most < 2.0 ** 24 else vecs

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        most = self.most * float(np.abs(anchor).max(initial=0))
        if most < 2.0 ** 24:  # all sums are exact in single precision
            return (self.narrow[rows] @ anchor.astype(np.float32)).astype(np.int64)
        if most < 2.0 ** 53:
            return (self.vecs[rows] @ anchor).astype(np.int64)
        return exact_products(anchor[None, :], self.vecs[rows])[0]

    def read(self, anchor: np.ndarray):
        """Rows not met before, their scores, and the threshold below which all
        further rows score at most (None: there are none), step by step."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):  # nothing to read by: every score is 0
            yield np.arange(n), np.zeros(n, np.int64), None
            return
        signed = np.concatenate([anchor[up], anchor[down]])
        met = np.zeros(n, bool)
        depth, step = 0, STEP
        while depth < n:
            end = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - end:n - depth].ravel()] = True
            fresh[self.order[down, depth:end].ravel()] = True
            fresh &= ~met
            met |= fresh
            depth, step = end, 2 * step
            rows = np.flatnonzero(fresh)
            threshold = None if depth == n or met.all() else _bound(
                signed, np.concatenate([self.values[up, n - 1 - depth], self.values[down, depth]]))
            yield rows, self.scores(anchor, rows), threshold
            if threshold is None:
                return


def _bound(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of two vectors of whole numbers, however large."""
    if float(np.abs(a) @ np.abs(b)) < 2.0 ** 53:
        return int(a @ b)
    return sum(int(x) * int(y) for x, y in zip(a, b))


class Kept:
    """The k best (score, smaller id first) rows of one list of results."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, least = scores.astype(np.int64), self.least()
        if least is not None:
            at = scores >= least
            scores, ids = scores[at], ids[at]
        if not len(ids):
            return
        if len(scores) > 8 * self.k:  # what ties with the k-th stays in
            at = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[at], ids[at]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[order], ids[order]

    def least(self) -> int | None:
        """The k-th score, once there are k."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None


def best_positives(lists: Lists, anchor: np.ndarray, vec_id: int, label: str, kept: Kept) -> int:
    """Offers ``kept`` the rows of ``label``; returns how many rows were scored."""
    done = 0
    for rows, scores, threshold in lists.read(anchor):
        done += len(rows)
        at = (lists.labels[rows] == lists.codes.get(label, -1)) & (lists.ids[rows] != vec_id)
        kept.offer(scores[at], lists.ids[rows[at]])
        least = kept.least()
        if threshold is not None and least is not None and threshold < least:
            break
    return done


def best_negatives(lists: Lists, anchor: np.ndarray, label: str, windows: list, kept: list[Kept]) -> int:
    """Offers each window's ``kept`` the rows of other labels inside it."""
    done, own = 0, lists.codes.get(label, -1)
    for rows, scores, threshold in lists.read(anchor):
        done += len(rows)
        # no window takes a score below its own bound or below the k-th it has
        lows = [low if best.least() is None else max(low, best.least())
                for (low, _), best in zip(windows, kept)]
        at = np.flatnonzero(scores >= min(lows))
        at = at[lists.labels[rows[at]] != own]
        scores, ids = scores[at], lists.ids[rows[at]]
        over = True
        for (low, high), floor, best in zip(windows, lows, kept):
            inside = (scores >= floor) & (scores <= high)
            best.offer(scores[inside], ids[inside])
            least = best.least()
            over &= threshold is not None and (threshold < low or least is not None and threshold < least)
        if over:
            break
    return done


def grid(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every pack of anchors beside every pack of candidates of its dimension."""
    rows = max(1, math.ceil(anchors.count() / CELL))
    columns = max(1, math.ceil(candidates.count() / CELL))
    place = lambda n: F.pmod(F.xxhash64("pack"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("dim", place(rows).alias("grid_row"), every(columns).alias("grid_column"),
                          *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "dim"])
    right = candidates.select("dim", every(rows).alias("grid_row"), place(columns).alias("grid_column"),
                              "pack", "ids", "labels", "vecs")
    return left.join(right, ["dim", "grid_row", "grid_column"])


def _search(pairs: DataFrame, schema: str, start, visit, rows_of) -> DataFrame:
    """Searches all pairs of packs. ``start(pack)`` makes what a pack of anchors
    keeps, ``visit(kept, lists)`` meets one pack of candidates and
    ``rows_of(kept)`` gives result columns. A task keeps the state of at most
    HELD_PACKS packs; a result handed on early is merged later like any other."""
    names = [part.split()[0] for part in schema.split(", ")]
    more = [c for c in pairs.columns if c in ("a_positive_ids", "a_positive_scores")]

    def run(batches):
        held: dict[str, object] = {}

        def out(pack):
            columns = rows_of(held.pop(pack))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        last: tuple = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: E731,B023
                asked, pack, dim = get("a_pack"), get("pack"), get("dim")
                if asked not in held:
                    if len(held) == HELD_PACKS:
                        yield out(next(iter(held)))
                    vecs = np.frombuffer(get("a_vecs"), "<f8").reshape(-1, dim)
                    held[asked] = start(get("a_ids"), get("a_labels"), vecs, *map(get, more))
                if last[0] != pack:
                    last = pack, Lists(np.array(get("ids"), np.int64), get("labels"),
                                       np.frombuffer(get("vecs"), "<f8").reshape(-1, dim))
                visit(held[asked], last[1])
        for pack in list(held):
            yield out(pack)

    return pairs.mapInArrow(run, schema)


def positives(anchors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, place (from 1): each anchor's best k."""
    def start(ids, labels, vecs):
        return ids, labels, vecs, [Kept(k) for _ in ids]

    def visit(held, lists):
        for vec_id, label, vec, kept in zip(*held):
            best_positives(lists, vec, vec_id, label, kept)

    def rows_of(held):
        ids, _, _, kept = held
        return (np.repeat(np.array(ids, np.int64), [len(x.ids) for x in kept]),
                np.concatenate([x.ids for x in kept]), np.concatenate([x.scores for x in kept]))

    asked = checkpointed(packed(anchors, ANCHOR_PACK), "anchors")
    found = _search(grid(asked, candidates), "anchor_id long, positive_id long, positive_score long",
                    start, visit, rows_of)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def window(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest s with low * positive_score <= 100 * s <= high * positive_score."""
    return -(-low * positive_score // 100), high * positive_score // 100


def negatives(anchors: DataFrame, found: DataFrame, candidates: DataFrame, k: int,
              low: int, high: int) -> DataFrame:
    """The best k rows of every positive's window; ``found`` are all positives."""
    in_order = F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    opened = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(in_order.alias("p"))
    asked = anchors.join(opened, "vec_id").select(
        "vec_id", "label", "vec", F.col("p.positive_id").alias("positive_ids"),
        F.col("p.positive_score").alias("positive_scores"))

    def start(ids, labels, vecs, positive_ids, scores):
        windows = [[window(s, low, high) for s in each] for each in scores]
        return ids, labels, vecs, positive_ids, scores, windows, [[Kept(k) for _ in w] for w in windows]

    def visit(held, lists):
        _, labels, vecs, _, _, windows, kept = held
        for label, vec, w, best in zip(labels, vecs, windows, kept):
            best_negatives(lists, vec, label, w, best)

    def rows_of(held):
        ids, _, _, positive_ids, scores, _, kept = held
        each = [(a, at, p, s, best) for a, ps, ss, bs in zip(ids, positive_ids, scores, kept)
                for at, (p, s, best) in enumerate(zip(ps, ss, bs))]
        n = [len(x[4].ids) for x in each]
        of = lambda i: np.repeat(np.array([x[i] for x in each], np.int64), n)
        none = np.empty(0, np.int64)
        return (of(0), of(1), of(2), np.concatenate([none, *[x[4].ids for x in each]]), of(3),
                np.concatenate([none, *[x[4].scores for x in each]]))

    asked = checkpointed(packed(asked, ANCHOR_PACK), "windows")
    rows = _search(grid(asked, candidates),
                   "anchor_id long, place long, positive_id long, negative_id long, "
                   "positive_score long, negative_score long", start, visit, rows_of)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", k_positives: int = POSITIVES,
                   k_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` are rows like ``vectors``. Rows with a null id or label, a null
    or empty vector, or a null or non-finite component take no part. Vectors
    meet anchors of their own dimension only. Rows that repeat an id are
    candidates each (a positive listed twice has its negatives twice); of the
    rows that repeat an anchor's id, the smallest (label, vector) is the anchor,
    and no row with the anchor's id is a candidate for it. Ties go to
    the smaller id. An anchor without positives, or whose windows are empty,
    has no rows; other columns are ignored; an empty table gives an empty
    result. A score beyond 64 bits is an error.
    """
    candidates = checkpointed(packed(usable(vectors, id_col, vec_col, label_col), PACK), "candidates")
    asked = checkpointed(
        usable(anchors, id_col, vec_col, label_col).groupBy("vec_id")
        .agg(F.min(F.struct("label", "vec")).alias("a")).select("vec_id", "a.label", "a.vec"), "asked")
    found = checkpointed(positives(asked, candidates, k_positives), "positives")
    return negatives(asked, found, candidates, k_negatives, low, high).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    """Labels of every seventh id are moved on first, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % ANCHOR_EVERY == 0))
