"""Ranked lexical search over trees of documents.

A document is cut to the items' terms (a restricted term vector: terms with
their number of occurrences), and its terms are put in the order of how many
documents hold them, commonest first. Documents in that order share the paths
of a trie; runs of the trie without a branch are one step. Every branch carries,
over all documents below it, each term's largest number of occurrences and the
smallest length measure m. As a score rises with the first and falls with the
second, the two bound the score of every document below the branch for any item.

The search goes depth first. A branch is entered with the items whose bound
there reaches their k-th score so far; children are bounded in one step, those
with the best bounds are entered first, and leaves (documents) get their exact
scores from the same expression. A task builds trees of a bounded size from its
own documents and hands on k rows per item.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import checkpointed, documents, read

K = 10
# Item terms whose table is sent to the executors at a time; more items take
# several passes over the documents (one item is never split).
PASS_TERMS = 200_000
GROUP_TERMS = 8192  # terms of the items that one tree serves (or one item's)
TREE_CELLS = 4 << 20  # documents times terms of one tree
MOST_TREE, LEAST_TREE = 1024, 64  # documents of one tree
CELLS = 1 << 20  # bounds computed in one step
_FOUND = "item_id long, doc_id long, score long"
_RESULT = "item_id long, rank int, doc_id long, score long"

# Letters A-Z lower-cased; ASCII signs that no term holds become blanks.
_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text (UTF-8), with repeats."""
    return text.translate(_SIGNS).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    def cut(batches):
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(terms_of(text or b""))
                ids += [item] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())],
                                             names=["item_id", "term"])

    return (items.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
            .mapInArrow(cut, "item_id long, term binary").distinct())


def vectors(docs: DataFrame, place: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Every document: doc_id, n (its terms with repeats), and of its terms in
    ``place`` their numbers and how often they occur."""
    def restrict(batches):
        for batch in batches:
            size, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).to_pylist():
                all_terms = terms_of(text or b"")
                tf: dict[int, int] = {}
                for term in filter(place.__contains__, all_terms):
                    at = place[term]
                    tf[at] = tf.get(at, 0) + 1
                size.append(len(all_terms))
                terms += tf
                counts += tf.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))],
                names=["doc_id", "n", "terms", "counts"])

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
            .mapInArrow(restrict, "doc_id long, n long, terms array<int>, counts array<int>"))


@dataclass
class Group:
    """Items that one tree serves. ``local`` gives a term's place in the tree's
    order (-1: no term of these items); item i of the group is item
    ``items[i]`` of the pass and has the terms ``of[i]``."""
    items: list[int]
    of: list[np.ndarray]
    local: np.ndarray
    weights: np.ndarray


def grouped(items: list[np.ndarray], df: np.ndarray, weights: np.ndarray,
            most: int = GROUP_TERMS) -> list[Group]:
    """Items put together up to ``most`` distinct terms, terms commonest first."""
    parts: list[tuple[list[int], set[int]]] = []
    for i, terms in enumerate(items):
        terms = {int(t) for t in terms if df[t]}
        if not terms:
            continue  # no document holds any of its terms
        if not parts or len(parts[-1][1] | terms) > most:
            parts.append(([], set()))
        parts[-1][0].append(i)
        parts[-1][1].update(terms)
    out = []
    for members, terms in parts:
        order = sorted(terms, key=lambda t: (-df[t], t))
        local = np.full(len(df), -1, np.int32)
        local[order] = np.arange(len(order), dtype=np.int32)
        of = [np.sort(local[items[i]][local[items[i]] >= 0]) for i in members]
        out.append(Group(members, of, local, weights[order]))
    return out


class Tree:
    """The trie of up to a few thousand documents, branches and leaves alike as
    rows of ``most`` (largest occurrences per term) and ``m`` (smallest m);
    row 0 is the root, ``children`` gives the rows below a branch."""

    def __init__(self, ids, m, docs, terms, counts, n_terms: int):
        """Document ``docs[j]`` has term ``terms[j]`` ``counts[j]`` times; sorted by both."""
        starts = np.searchsorted(docs, np.arange(len(ids) + 1))
        wide = terms.astype(">u4").tobytes()
        paths = [wide[4 * a:4 * b] for a, b in zip(starts[:-1], starts[1:])]
        order = sorted(range(len(ids)), key=paths.__getitem__)
        self.ids, self.children = np.asarray(ids)[order], {}
        leaf = np.empty(len(order), np.int64)
        leaf[order] = np.arange(len(order))
        shared = [_shared(paths[a], paths[b]) for a, b in zip(order, order[1:])]
        n = self._branch(shared, len(order))
        self.first_leaf = n
        self.most = np.zeros((n + len(order), n_terms), np.int32)
        self.most[n + leaf[docs], terms] = counts
        self.m = np.empty(n + len(order), np.int64)
        self.m[n:] = np.asarray(m)[order]
        for row in range(n - 1, -1, -1):  # children come after their branch
            below = self.children[row] = np.array(self.children[row])
            below[below < 0] = n - 1 - below[below < 0]  # a leaf was noted as -1 - its place
            self.most[row] = self.most[below].max(axis=0)
            self.m[row] = self.m[below].min()

    def _branch(self, shared: list[int], leaves: int) -> int:
        """Branches from the lengths of the paths that neighbours share. Each
        row's number is smaller than those of the branches below it."""
        nodes: list[list] = []  # (depth, children), numbered when closed
        open_ = [[-1, []]]
        open_[0][1].append(-1)
        for at in range(1, leaves):
            depth, last = shared[at - 1], None
            while open_[-1][0] > depth:
                nodes.append(open_.pop()[1])
                last = len(nodes) - 1
                if open_[-1][0] <= depth:
                    break
                open_[-1][1].append(("branch", last))
                last = None
            if open_[-1][0] < depth:  # the latest child moves below a new branch
                moved = ("branch", last) if last is not None else open_[-1][1].pop()
                open_.append([depth, [moved]])
            elif last is not None:
                open_[-1][1].append(("branch", last))
            open_[-1][1].append(-1 - at)
        while len(open_) > 1:
            nodes.append(open_.pop()[1])
            open_[-1][1].append(("branch", len(nodes) - 1))
        nodes.append(open_[0][1])
        total = len(nodes)
        for number, below in enumerate(nodes):
            self.children[total - 1 - number] = [
                total - 1 - c[1] if isinstance(c, tuple) else c for c in below]
        return total


def _shared(a: bytes, b: bytes) -> int:
    """Length of the path that two documents share, in terms."""
    n = min(len(a), len(b)) // 4
    same = np.frombuffer(a, ">u4", n) == np.frombuffer(b, ">u4", n)
    return n if same.all() else int(same.argmin())


class Ranking:
    """The k best (score, smaller doc_id first) of every item of a pass."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a lower score has no place

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps[item]
        for score, doc in zip(scores.tolist(), ids.tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -doc))
            elif (score, -doc) > heap[0]:
                heapq.heapreplace(heap, (score, -doc))
        if len(heap) == self.k:
            self.least[item] = heap[0][0]

    def rows(self):
        return [(i, -doc, score) for i, heap in enumerate(self.heaps) for score, doc in heap]


def search(tree: Tree, group: Group, best: Ranking) -> int:
    """Depth-first branch and bound of all items of ``group``; returns how many
    (item, row) bounds were computed."""
    members = np.array(group.items)
    todo = [(0, np.arange(len(members)), np.full(len(members), np.iinfo(np.int64).max))]
    done = 0
    while todo:
        row, active, bounds = todo.pop()
        # a bound equal to the k-th score may hide a tie with a smaller id
        active = active[bounds >= best.least[members[active]]]
        if not len(active):
            continue
        terms = [group.of[i] for i in active]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])[:-1]])
        terms = np.concatenate(terms)
        weights = group.weights[terms]
        below, found = tree.children[row], []
        step = max(1, CELLS // len(terms))
        for a in range(0, len(below), step):
            rows = below[a:a + step]
            tf = tree.most[rows[:, None], terms[None, :]].astype(np.int64)
            gain = weights * (1_000_000_000 * tf // (1000 * tf + 8 * tree.m[rows][:, None]))
            bound = np.add.reduceat(gain, ends, axis=1)
            done += bound.size
            leaves = rows >= tree.first_leaf
            if leaves.any():
                ids, exact = tree.ids[rows[leaves] - tree.first_leaf], bound[leaves]
                reach = exact >= best.least[members[active]][None, :]
                for i in np.flatnonzero(reach.any(axis=0)):
                    at = reach[:, i]
                    best.offer(int(members[active[i]]), exact[at, i], ids[at])
            found += [(int(r), active, b) for r, b in zip(rows[~leaves], bound[~leaves])]
        todo += sorted(found, key=lambda f: int(f[2].max()))
    return done


def _ranked(rows: DataFrame, groups: list[Group], names: list[int], scale: tuple[int, int],
            k: int) -> DataFrame:
    """k rows per item of every task; ``rows`` are vectors with m."""
    def run(batches):
        best = Ranking(len(names), k)
        sizes = [min(MOST_TREE, max(LEAST_TREE, TREE_CELLS // len(g.weights))) for g in groups]
        held: list[list] = [[] for _ in groups]  # batches of documents waiting for a tree

        def grow(g: int, parts) -> None:
            ids, m, lengths, terms, counts = (np.concatenate(x) for x in zip(*parts))
            docs = np.repeat(np.arange(len(ids)), lengths)
            order = np.lexsort((terms, docs))
            tree = Tree(ids, m, docs[order], terms[order], counts[order], len(groups[g].weights))
            search(tree, groups[g], best)

        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            terms, counts = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            of = np.repeat(np.arange(len(ids)), lengths)
            for g, group in enumerate(groups):
                local = group.local[terms]
                at = local >= 0
                some, n = np.unique(of[at], return_counts=True)
                flat = np.concatenate([[0], np.cumsum(n)])
                part = ids[some], m[some], n, local[at], counts[at]
                for a in range(0, len(some), sizes[g]):
                    b = min(len(some), a + sizes[g])
                    held[g].append((*(x[a:b] for x in part[:3]), *(x[flat[a]:flat[b]] for x in part[3:])))
                    while sum(len(p[0]) for p in held[g]) >= sizes[g]:
                        grow(g, held[g])
                        held[g] = []
        for g, parts in enumerate(held):
            if parts:
                grow(g, parts)
        item, doc, score = zip(*best.rows()) if any(best.heaps) else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in item], pa.int64()), pa.array(doc, pa.int64()),
             pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    documents_with_terms, length = scale
    m = F.expr(f"10 + cast((cast(n as decimal(20,0)) * {90 * documents_with_terms}) div {length} as long)")
    return (rows.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
            .select("doc_id", m.alias("m"), "terms", "counts").mapInArrow(run, _FOUND))


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", k: int = K,
                  pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` best documents.

    A null or empty text has no terms: such a document counts in no statistic,
    such an item gets no row. A document with a null id counts in the
    statistics and is no result; an item with a null id is not asked. Rows that
    repeat a document's id are documents each; rows that repeat an item's id
    are one item with the terms of all. Equal scores go by ascending doc_id.
    Whole texts are read, however long; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    wanted = checkpointed(item_terms(items, item_id_col, item_text_col), "item-terms")
    passes = max(1, math.ceil(wanted.count() / pass_terms))
    part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    found = []
    for number in range(passes):
        of: dict[int, list[bytes]] = {}
        for row in wanted.where(part == number).collect():  # about pass_terms rows
            of.setdefault(row["item_id"], []).append(bytes(row["term"]))
        place = {t: i for i, t in enumerate(sorted({t for terms in of.values() for t in terms}))}
        if not place:
            continue
        rows = checkpointed(vectors(docs, place, id_col, text_col), "term-vectors")
        scale = rows.agg(F.count_if(F.col("n") > 0).alias("documents"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not scale["documents"]:
            continue
        df = np.zeros(len(place), np.int64)
        for row in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[row["t"]] = row["count"]  # one row per term of this pass
        weights = np.array([math.floor(1000 * math.log((2 * scale["documents"] + 2) / (2 * int(d) + 1)))
                            for d in df], np.int64)
        names = sorted(of)
        groups = grouped([np.array([place[t] for t in of[i]]) for i in names], df, weights)
        found.append(_ranked(rows, groups, names, tuple(scale), k))
    if not found:
        return spark.createDataFrame([], _RESULT)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
