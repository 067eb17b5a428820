"""Top-k search and vector near duplicates against brute force."""

import math

import numpy as np
import pytest

from mercato.llm.embed_dedup import linked, near_duplicates, quantise
from mercato.llm.topk_search import Best, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string, ints int"


def vectors(n, dim, seed, groups=6, noise=0.15):
    """Vectors around a few centres, so that there are links of every strength."""
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(groups, dim))
    spread = noise * pick.random((n, 1))
    return (centres[pick.integers(0, groups, n)] + spread * pick.normal(size=(n, dim))).astype(np.float32)


def table(spark, vecs, labels):
    rows = [(i, [float(x) for x in v], label, "x", 0) for i, (v, label) in enumerate(zip(vecs, labels))]
    rows += [
        (9001, None, 0, "x", 0), (9002, [1.0, None] * 4, 0, "x", 0), (9003, [math.nan] * 8, 0, "x", 0),
        (9004, [math.inf] * 8, 0, "x", 0), (9005, [0.0] * 8, 0, "x", 0), (9006, [], 0, "x", 0),
        (9007, [float(x) for x in vecs[0]], None, "x", 0), (9008, [1.0, 2.0], 0, "x", 0),
        (None, [float(x) for x in vecs[0]], 0, "x", 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_top_k_equals_brute_force(spark):
    vecs = vectors(700, 8, 1)
    vecs[40:60] = vecs[0]  # ties
    frame = table(spark, vecs, [0] * len(vecs))
    usable = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(np.int64)
              for r in frame.collect() if r.vec_id is not None and r.embedding
              and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = []
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-int(usable[c] @ usable[q]), c) for c in usable
                      if c != q and len(usable[c]) == len(usable[q]))[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score)
           for r in top_k(frame, frame.where("vec_id % 50 = 0"), block=64).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_of_large_components_is_exact(spark):
    """Products of 2**31 and more, also where a vector's product with itself passes 64 bits."""
    rows = [(50, [1e8, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 1e8]), (100, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(frame, frame.where("vec_id % 50 = 0"), k=2).collect())
    whole = {i: [int(256 * x) for x in np.array(v, np.float32).astype(float)] for i, v in rows}
    want = []
    for q in (50, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:2]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and max(s for *_, s in got) > 2 ** 41


def test_top_k_edges(spark):
    frame = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]),
                                   (100, [-1.0, 3e38])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score)
                 for r in top_k(frame, frame.where("vec_id = 50")).collect())
    assert got == [(50, 1, 1, 32768), (50, 2, 1, 32768), (50, 3, 100, -65536)]
    assert top_k(frame.limit(0), frame).count() == 0
    assert top_k(frame, frame.limit(0)).count() == 0
    assert top_k(frame.where("vec_id = 50"), frame.where("vec_id = 50")).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    pick = np.random.default_rng(2)
    centres = pick.integers(-200, 200, (20, 16))
    ids = np.arange(5000)
    vecs = (centres[ids // 250] + pick.integers(-5, 5, (5000, 16))).astype("<i4")
    best = Best(ids[:40], vecs[:40], 5)
    scored = best.search(ids, vecs, 250)
    assert scored < 40 * 20
    for q in range(40):
        scores = vecs.astype(np.int64) @ vecs[q].astype(np.int64)
        scores[q] = np.iinfo(np.int64).min + 1
        want = sorted(zip(-scores, ids))[:5]
        assert [(-s, i) for s, i in zip(best.scores[q], best.ids[q])] == want


def components(ids, adjacent):
    root = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in adjacent:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("tile", [32, 1024])
def test_near_duplicates_equal_brute_force(spark, tile):
    vecs = vectors(400, 8, 3)
    labels = [None if i % 41 == 0 else (0 if i % 3 else 1) for i in range(len(vecs))]
    frame = table(spark, vecs, labels)
    rows = [r for r in frame.collect()]
    usable = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in rows
              if r.vec_id is not None and r.label is not None and r.embedding
              and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    pairs = [(a[0], b[0]) for n, a in enumerate(usable) for b in usable[:n]
             if a[1] == b[1] and len(a[2]) == len(b[2])
             and a[2] @ b[2] / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])) >= 0.93]
    ids = [r.vec_id for r in rows if r.vec_id is not None]
    root = components(ids, pairs)
    degree = {i: sum(i in p for p in pairs) for i in ids}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(frame, tile=tile).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (degree[i], root[i], root[i] == i) for i in ids}
    assert 0 < len(pairs) and near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    vecs = vectors(300, 64, 4, noise=1.0).astype(float)
    ints, scales = quantise(vecs)
    side = {"ids": np.arange(len(vecs)), "ints": ints, "scales": scales, "vecs": vecs}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    products = ints.astype(float) @ ints.T.astype(float) * np.outer(scales[:, 0], scales[:, 0])
    error = np.outer(scales[:, 1], scales[:, 2]) + scales[:, 2][:, None]
    assert (np.abs(unit @ unit.T - products) <= error + 1e-12).all()
    i, j = linked(side, side, 0.5, True)
    want = np.argwhere(np.triu(unit @ unit.T >= 0.5, 1))
    assert sorted(zip(i, j)) == sorted(map(tuple, want))


def test_repeated_rows_are_one_vector(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)],
                                  "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in near_duplicates(frame).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False)]


def test_rows_that_differ_under_one_id_all_link(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (5, [0.0, 1.0], 0), (5, [1.0, 0.0], 1), (5, [1.0, 0.01], 0),
            (3, [1.0, 0.02], 0), (7, [0.02, 1.0], 0), (9, [1.0, 0.02], 1), (11, [-1.0, 0.0], 0)]
    for part in (rows, rows[::-1]):
        frame = spark.createDataFrame(part, "vec_id long, embedding array<float>, label int")
        for tile in (2, 1024):
            got = sorted(tuple(r) for r in near_duplicates(frame, tile=tile).collect())
            assert got == [(3, 2, 3, True), (5, 4, 3, False), (7, 1, 3, False), (9, 1, 3, False), (11, 0, 11, True)]
