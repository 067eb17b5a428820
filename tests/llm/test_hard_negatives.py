"""Hard negatives: brute force, the reading's threshold, edges."""

import math

import numpy as np
import pytest

from mercato.llm.common import exact_products
from mercato.llm.hard_negatives import (Kept, Lists, best_negatives, best_positives, hard_negatives,
                                        window)

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, place int"


def usable(rows):
    return [(i, np.floor(256 * np.array(v, np.float32).astype(float)), label) for i, v, label, *_ in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]


def inner(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


def brute(rows, anchor_every=50):
    rows, out = usable(rows), []
    for a, av, label in rows:
        if a % anchor_every:
            continue
        scored = [(-inner(av, v), i, other) for i, v, other in rows if i != a and len(v) == len(av)]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted((s, i) for s, i, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(a, pid, n, i, -p, -s) for n, (s, i) in enumerate(fit[:3], 1)]
    return sorted(out)


def run(spark, rows, **kwargs):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives(frame, frame.where("vec_id % 50 = 0"), **kwargs)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                  for r in got.collect())


def invented(seed, n, dim, labels=4):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(5, dim))
    vecs = centres[pick.integers(0, 5, n)] + 0.5 * pick.normal(size=(n, dim))
    return [(i, [float(x) for x in v], int(pick.integers(0, labels)), "x", 0) for i, v in enumerate(vecs)]


def test_equals_brute_force(spark):
    rows = invented(1, 400, 8)
    rows[100:130] = [(i, rows[7][1], label, "x", 0) for i, _, label, *_ in rows[100:130]]  # ties
    rows += [(9000, None, 0, "x", 0), (9050, [1.0, None], 0, "x", 0), (9100, [math.nan] * 8, 0, "x", 0),
             (9150, [math.inf] * 8, 0, "x", 0), (9200, [0.0] * 8, 0, "x", 0), (9250, [], 0, "x", 0),
             (9300, rows[0][1], None, "x", 0), (9350, [1.0, 2.0], 0, "x", 0), (9351, [1.0, 1.0], 0, "x", 0),
             (9352, [1.0, 1.0], 1, "x", 0), (None, rows[0][1], 0, "x", 0)]
    assert run(spark, rows) == brute(rows)


def test_a_hot_label_and_a_label_of_one_row(spark):
    rows = [(i, v, 0 if i % 3 else 1, "x", 0) for i, v, *_ in invented(2, 150, 4)]
    rows[50] = (50, rows[50][1], 7, "x", 0)  # an anchor without positives
    assert run(spark, rows) == brute(rows)


def test_rows_that_repeat_an_id(spark):
    """An anchor's repeats are one anchor (of the smallest label and vector); other rows count each."""
    rows = [(50, [1.0, 0.5], 1, "x", 0), (50, [1.0, 0.5], 1, "x", 0), (50, [9.0, 9.0], 2, "x", 0),
            (1, [1.0, 0.25], 1, "x", 0), (1, [1.0, 0.25], 1, "x", 0),
            (2, [0.5, 0.5], 2, "x", 0), (2, [0.5, 0.5], 2, "x", 0)]
    s, t = inner([256, 128], [256, 64]), inner([256, 128], [128, 128])
    assert run(spark, rows) == [(50, 1, n, 2, s, t) for n in (1, 1, 2, 2)]


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0, "x", 0)]) == []
    assert run(spark, [(50, [1.0], 0, "x", 0)]) == []


def test_large_components_are_exact(spark):
    rows = [(0, [1e8, 0.0], 1, "x", 0), (1, [1.0, 3.0], 1, "x", 0), (2, [0.75, 1e8], 2, "x", 0)]
    want = [(0, 1, 1, 2, 25_600_000_000 * 256, 25_600_000_000 * 192)]
    assert run(spark, rows) == want == brute(rows)
    wide = np.array([[2.0 ** 40, 1.0]])
    assert exact_products(wide, np.array([[2.0 ** 20, 3.0]])).tolist() == [[2 ** 60 + 3]]
    assert exact_products(np.array([[2.0 ** 40, -(2.0 ** 40)]]), np.array([[2.0 ** 30, 2.0 ** 30]])).tolist() == [[0]]
    assert exact_products(wide, np.array([[2.0 ** 40, 1.0]])).tolist() == [[2 ** 80 + 1]]


def test_a_score_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="OverflowError"):
        run(spark, [(0, [1e8], 1, "x", 0), (1, [1e8], 1, "x", 0)])


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 2, 3, 199, 200, 10_001])
def test_window_bounds(score):
    low, high = window(score, 50, 95)
    inside = [s for s in range(-3 * abs(score) - 5, 3 * abs(score) + 6) if 50 * score <= 100 * s <= 95 * score]
    assert inside == list(range(low, high + 1))


def test_reading_stops_early_and_misses_nothing():
    pick = np.random.default_rng(4)
    vecs = np.floor(256 * pick.exponential(size=(3000, 3)) ** 3)
    labels = [str(x) for x in pick.integers(0, 3, 3000)]
    lists = Lists(np.arange(3000), labels, vecs)
    stopped = 0
    for row in range(0, 300, 10):
        anchor = vecs[row] * pick.choice([-1, 1, 0], 3)
        kept = Kept(5)
        done = best_positives(lists, anchor, row, labels[row], kept)
        stopped += done < 3000
        scores = vecs @ anchor
        want = sorted((-int(scores[i]), i) for i in range(3000) if i != row and labels[i] == labels[row])[:5]
        assert [(-s, i) for s, i in zip(kept.scores.tolist(), kept.ids.tolist())] == want
        windows = [window(s, 50, 95) for s in kept.scores.tolist()]
        found = [Kept(3) for _ in windows]
        best_negatives(lists, anchor, labels[row], windows, found)
        for (low, high), best in zip(windows, found):
            want = sorted((-int(scores[i]), i) for i in range(3000)
                          if labels[i] != labels[row] and low <= scores[i] <= high)[:3]
            assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want
    assert stopped
