"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from mercato.llm import ngram_join
from mercato.llm.ngram_join import (SHARES, Similarity, chosen_bands, gram_set, index_keys, possible_bands,
                                    schemes, similarity_groups, word_hashes)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gram_sets(texts, k):
    out = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(low)
        grams = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        out.append(grams)
    return out


def brute(rows, k, num, den):
    """doc_id -> smallest id reachable by links."""
    sets = gram_sets([t for _, t in rows], k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), smallest[find(i)]) for i, (doc_id, _) in enumerate(rows))


def corpus(seed, n=220):
    """Texts of all sizes, many of them copies with a few words changed."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and pick.random() < 0.7:
            base = pick.choice(texts[-30:]).split()
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5])):
                at = pick.randrange(len(base) + 1)
                if pick.random() < 0.5 and len(base) > 1:
                    del base[at - 1]
                else:
                    base.insert(at, pick.choice(words))
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(pick.choices(words, k=pick.choice([1, 2, 3, 5, 12, 30, 80, 200, 600]))))
    return [(1000 - i, t) for i, t in enumerate(texts)]


def groups(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "doc_id long, text string, size string, node int")
    return sorted((r.doc_id, r.n_shingles, r.component_id)
                  for r in similarity_groups(frame, **options).collect())


@pytest.mark.parametrize("seed,k,num,percent", [(1, 3, 90, None), (2, 5, 80, None), (3, 3, 80, 100),
                                                (4, 2, 70, 50)])
def test_groups_equal_brute_force(spark, seed, k, num, percent):
    rows = corpus(seed)
    want = brute(rows, k, num, 100)
    assert len({c for _, _, c in want}) < len(rows)
    assert groups(spark, rows, k=k, num=num, den=100, single_percent=percent) == want


def test_buckets_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    pick = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(pick.choice([1, 2, 4, 6])):
            copy[pick.randrange(len(copy))] = f"x{pick.randrange(10 ** 6)}"
        rows.append((i, " ".join(copy)))
    assert groups(spark, rows, k=3, num=90, den=100) == brute(rows, 3, 90, 100)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  Two"),
            (8, "a b c"), (8, "a b c"), (9, "A B C"), (10, "É b c"), (11, "é b c"), (12, "a b c d"),
            (13, "w " * 30_000)]
    got = groups(spark, rows, k=3, num=90, den=100)
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8),
                   (8, 1, 8), (9, 1, 8), (10, 1, 10), (11, 1, 11), (12, 1, 12), (13, 1, 13)]
    frame = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "x y z"), (None, "other words here")],
                                  "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id)) for r in similarity_groups(frame, k=3).collect())
    assert got == ["(5, 5)", "(None, 5)", "(None, 5)", "(None, None)"]
    assert similarity_groups(frame.limit(0)).count() == 0


def test_hashes_follow_words_not_places(monkeypatch):
    text = "Alpha beta\tALPHA\n beta  alpha" + " é" * 3
    whole = word_hashes(text)
    assert len(whole) == 8 and whole[0] == whole[2] == whole[4] and whole[1] == whole[3]
    assert len(set(whole.tolist())) == 3
    monkeypatch.setattr(ngram_join, "WINDOW", 4)
    assert (word_hashes(text) == whole).all()
    assert len(gram_set("a b c a b c", 3)) == 3


@pytest.mark.parametrize("num", [70, 80, 90])
@pytest.mark.parametrize("cut", range(len(SHARES)))
def test_linked_sets_share_a_key(num, cut):
    similarity = Similarity(num, 100)
    pick = np.random.default_rng(num)
    bands = [possible_bands(similarity, number)[cut] for number in range(20)]
    assert bands[-1].high > 3000
    for size in (1, 2, 5, 9, 10, 11, 19, 20, 33, 60, 100, 240, 999, 2400):
        for _ in range(15):
            a = np.unique(pick.integers(0, 2 ** 63, size, dtype=np.uint64) * np.uint64(2))
            gone = pick.integers(0, len(a) + 1)
            b = a
            while True:  # as many random changes as the similarity allows
                c = np.delete(b, pick.integers(0, len(b))) if len(b) > 1 and pick.random() < 0.5 else \
                    np.unique(np.append(b, pick.integers(0, 2 ** 63, 1, dtype=np.uint64)))
                shared = len(np.intersect1d(a, c))
                if 100 * shared < num * (len(a) + len(c) - shared) or len(c) > len(a) + gone:
                    break
                b = c
            if len(a) == len(b) and (a == b).all():
                continue
            keys = [set(np.concatenate([index_keys(s, n, bands[n]) for n in schemes(len(s), bands, similarity)]
                                       or [np.empty(0, np.uint64)]).tolist()) for s in (a, b)]
            assert keys[0] & keys[1], (len(a), len(b))


def test_the_cut_follows_the_pairs_that_meet():
    similarity = Similarity(80, 100)
    sets = {number: 1000 for number in range(14)}
    plain = chosen_bands(similarity, 400, sets, {})
    assert all(band.single == 0 for band in plain)
    crowded = {ngram_join._tag(number, 0, 0): 1e12 for number in range(14)}
    cut = chosen_bands(similarity, 400, sets, crowded)
    assert all(band.single > 0 for band in cut if band.apart > 2)
    assert all(band.exact + 2 * band.single > band.apart for band in plain + cut)
    assert chosen_bands(similarity, 0, {}, {}) == []


def test_meetings_are_estimated_from_few_segments(spark, monkeypatch):
    """Sets that share half of their elements meet about as often as a full index says."""
    similarity = Similarity(80, 100)
    pick = np.random.default_rng(3)
    draw = lambda n: pick.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2)
    common = draw(30)
    sets = [np.unique(np.concatenate([common, draw(10)])) for _ in range(300)]
    rows = [(i, *ngram_join.probes(s, similarity)) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, probes array<long>, tags array<int>")
    met = ngram_join.meetings(frame, similarity)
    number = ngram_join._band_number(40)
    band = possible_bands(similarity, number)[0]
    found = {}
    for s in sets:
        for key in index_keys(s, number, band).tolist():
            found[key] = found.get(key, 0) + 1
    full = sum(n * (n - 1) // 2 for n in found.values())
    assert full / 20 < met[ngram_join._tag(number, 0, 0)] < full * 20


def test_words_that_equal_a_polynomial_everywhere_do_not_link(spark):
    """A Thue-Morse word and its complement: equal under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    assert word_hashes(one)[0] != word_hashes(other)[0]
    got = groups(spark, [(1, one), (2, other), (3, one)], k=3, num=90, den=100)
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
