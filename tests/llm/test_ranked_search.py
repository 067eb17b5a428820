"""Ranked lexical search: brute force, the tree's bounds, ties and edges."""

import math
import re

import numpy as np
import pytest

from mercato.llm.ranked_search import (Group, Ranking, Tree, grouped, ranked_search, search,
                                       terms_of)

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    """(item, rank, doc, score) of rows (id, text), by the formula alone."""
    tf = [{t: words.count(t) for t in set(words)} for words in (cut(text) for _, text in docs)]
    n = [sum(x.values()) for x in tf]
    total, length = sum(x > 0 for x in n), sum(n)
    df = {}
    for x in tf:
        for t in x:
            df[t] = df.get(t, 0) + 1
    terms = {}
    for item, text in items:
        if item is not None:
            terms.setdefault(item, set()).update(cut(text))
    out = []
    for item, wanted in terms.items():
        found = []
        for (doc, _), x, size in zip(docs, tf, n):
            m = 10 + (90 * size * total) // length if length else 10
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * x[t]) // (1000 * x[t] + 8 * m)) for t in wanted if t in x)
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, i, d, -s) for i, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, docs, items, **kwargs):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.item_id, r["rank"], r.doc_id, r.score)
                  for r in ranked_search(docs, items, **kwargs).collect())


def invented(seed, n, words=60, longest=40):
    pick = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(pick.choice(vocabulary, pick.integers(1, longest), p=share / share.sum())) for _ in range(n)]


def test_terms_are_the_pattern():
    text = "".join(map(chr, range(1, 0x250))) + " Ünï-CODE K x_y 3.14 \U0001f600z"
    assert [t.decode() for t in terms_of(text.encode())] == cut(text)


@pytest.mark.parametrize("pass_terms", [200_000, 40])
def test_equals_brute_force(spark, pass_terms):
    texts = invented(1, 400)
    docs = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[3]) for i in range(30)]  # ties
    items = list(enumerate(invented(2, 12, longest=15)))
    assert run(spark, docs, items, pass_terms=pass_terms) == brute(docs, items)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "apple pear"), (4, "Apple apple PEAR"), (4, "apple"),
            (5, "quince " * 50_000), (6, "pear"), (6, "pear"), (7, "kiwi"), (8, "plum")]
    items = [(1, "apple"), (2, None), (3, "..."), (None, "apple"), (4, "pear"), (4, "quince quince"),
             (5, "nowhere"), (6, "APPLE, pear!")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=1) == brute(docs, items, 1)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, None)], items) == []


def test_a_term_of_every_document_weighs_nothing(spark):
    docs = [(i, "same") for i in range(2000)]
    assert run(spark, docs, [(1, "same")]) == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.sql("select 1L as doc_id, 'a b' as text, 'x' as terms, 2 as n, 3 as score, 'y' as item_id"
                     " union all select 2L, 'c', '', 0, 0, ''")
    items = spark.sql("select 9L as item_id, 'b' as text, 7 as doc_id, 'q' as term")
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranked_search(docs, items).collect()] == [(9, 1, 1)]


def test_bounds_hold_and_branches_are_skipped():
    """The search equals scoring every document, and leaves branches out."""
    pick = np.random.default_rng(5)
    n_terms, n_docs = 300, 600
    share = 1 / np.arange(1, n_terms + 1) ** 0.8
    rows = [np.unique(pick.choice(n_terms, pick.integers(1, 30), p=share / share.sum())) for _ in range(n_docs)]
    docs = np.repeat(np.arange(n_docs), [len(r) for r in rows])
    terms = np.concatenate(rows)
    counts = pick.integers(1, 5, len(terms))
    m = pick.integers(10, 300, n_docs)
    df = np.bincount(terms, minlength=n_terms)
    weights = pick.integers(1, 9000, n_terms)
    items = [pick.choice(n_terms, 8, replace=False) for _ in range(20)]
    (group,) = grouped(items, df, weights)
    known = group.local[terms] >= 0
    local = group.local[terms[known]]
    order = np.lexsort((local, docs[known]))
    some, dense = np.unique(docs[known], return_inverse=True)
    tree = Tree(some, m[some], dense[order], local[order], counts[known][order], len(group.weights))
    for branch, below in tree.children.items():
        assert (tree.most[below] <= tree.most[branch]).all() and (tree.m[below] >= tree.m[branch]).all()
    best = Ranking(len(items), 3)
    done = search(tree, group, best)
    assert done < len(items) * len(tree.m)
    for i, wanted in enumerate(items):
        scored = []
        for d in range(n_docs):
            tf = dict(zip(terms[docs == d].tolist(), counts[docs == d].tolist()))
            s = sum(int(weights[t]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * int(m[d])))
                    for t in wanted.tolist() if t in tf)
            if s:
                scored.append((-s, d))
        assert sorted((-s, -d) for s, d in best.heaps[i]) == sorted(scored)[:3]


def test_items_are_grouped_by_their_terms():
    df = np.array([5, 3, 9, 0, 1])
    items = [np.array([0, 1]), np.array([3]), np.array([2, 3]), np.array([0, 4])]
    groups = grouped(items, df, np.arange(5), most=3)
    assert [g.items for g in groups] == [[0, 2], [3]]
    assert isinstance(groups[0], Group) and groups[0].weights.tolist() == [2, 0, 1]  # commonest first
    assert [x.tolist() for x in groups[0].of] == [[1, 2], [0]]
