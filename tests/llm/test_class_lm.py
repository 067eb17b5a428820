"""Class-based language model: counts and base by brute force, the exchange's
gains, probabilities that sum to one, held-out perplexity, edges."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercato.llm import class_lm as lm
from mercato.llm.common import documents
from tests.conftest import SF_ORACLE, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "a b a"), (2, None), (3, ""), (4, " \t\r\n\x0b\x0c"), (5, "A\x1cb  x y É é"), (None, "b c"),
       (None, "b c"), (6, "a b a"), (6, "a b a"), (7, "unseen words here"), (8, "a " * 50_000), (9, "z" * 30_000)]


def tokens(text):
    return [*WORD.findall((text or "").translate(UPPER)), None]  # None: the end


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base) by the formula alone."""
    counts = {}
    for doc_id, text in rows:
        if not held_out(doc_id):
            for t in tokens(text):
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(d, held_out(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n,
             sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def scored(docs, **kwargs):
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return lm.class_lm(docs, F.crc32(name) % 7 != 2, **kwargs).collect()


def compare(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(g[6]) and g[6] < 0 or g[4] == 0


def test_base_of_a_whole_table_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).collect()]
    compare(lm.op13_class_lm(spark, SF_SMALL).collect(), brute(rows))


def test_edges(spark):
    compare(scored(frame(spark, ODD)), brute(ODD))
    assert scored(frame(spark, [])) == []
    nobody = [(d, "a b") for d in range(200) if held_out(d)]
    compare(scored(frame(spark, nobody)), brute(nobody))
    extra = frame(spark, ODD).selectExpr("*", "1 as c", "2 as word", "'x' as chunk", "true as held_out")
    compare(scored(extra), brute(ODD))


def test_equal_rows_have_equal_scores(spark):
    got = scored(frame(spark, ODD))
    assert len({r.score for r in got if r.doc_id in (1, 6)}) == 1
    assert len({r.score for r in got if r.doc_id is None}) == 1


def test_chunks_change_nothing(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).collect()][:60] + ODD
    one = {(r.doc_id, r.n_tokens): r for r in scored(frame(spark, rows))}
    monkeypatch.setattr(lm, "CHUNK", 300)
    monkeypatch.setattr(lm, "PAIRS", 500)
    many = {(r.doc_id, r.n_tokens): r for r in scored(frame(spark, rows).repartition(7))}
    assert one.keys() == many.keys()
    for key, r in one.items():
        assert many[key].n_known == r.n_known and many[key].base_score == pytest.approx(r.base_score)
        assert many[key].score == pytest.approx(r.score)


def test_split_gives_the_words_of_every_text(monkeypatch):
    pick = np.random.default_rng(3)
    bits = [b"a", b"B", b" ", b"\t", b"\x0b", b"\x0c", b"\r\n", b"\x1c", "É".encode(), b"\xc2\xa0", b"\xff", b"\x85", b"\x00"]
    texts = [None, b"", b" ", b"a", *(b"".join(bits[i] for i in pick.integers(0, len(bits), n % 13)) for n in range(900))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(lm, "SLICE", size)
        got = []
        for part in lm.slices(batch, 0):
            words, offsets = lm.split(part.column(0))
            different, code = lm.distinct(words)
            words = words.to_pylist()
            assert [different[i] for i in code] == words and len(set(different)) == len(different)
            got += [words[a:b] for a, b in zip(offsets, offsets[1:])]
        assert got == [lm.words_of(t) for t in texts]


def test_slices_change_nothing(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).collect()][:40] + ODD
    one = {(r.doc_id, r.n_tokens): r for r in scored(frame(spark, rows), rounds=1)}
    monkeypatch.setattr(lm, "SLICE", 1000)
    monkeypatch.setattr(lm, "CHUNK", 300)
    for r in scored(frame(spark, rows).repartition(2), rounds=1):
        want = one[r.doc_id, r.n_tokens]
        assert r.n_known == want.n_known and r.base_score == pytest.approx(want.base_score)
        assert r.score == pytest.approx(want.score)


def test_gains_are_differences_of_the_likelihood():
    pick = np.random.default_rng(0)
    symbols, kinds, choices = 30, 8, 5
    text = pick.integers(0, symbols, 3000)
    text[1:][pick.random(2999) < 0.3] = 4  # a word often beside itself
    pairs = np.zeros((symbols, symbols), np.int64)
    np.add.at(pairs, (text[:-1], text[1:]), 1)
    classes = pick.integers(0, choices, symbols)
    classes[-3:] = [5, 6, 7]

    def counts(of):
        out = np.zeros((kinds, kinds), np.int64)
        np.add.at(out, (of[text[:-1]], of[text[1:]]), 1)
        return out

    for word in range(27):
        own = classes[word]
        follow = np.bincount(classes, pairs[word], kinds).astype(np.int64)
        precede = np.bincount(classes, pairs[:, word], kinds).astype(np.int64)
        gain = lm.gains(counts(classes), own, follow, precede, pairs[word, word], choices)
        for to in range(choices):
            moved = classes.copy()
            moved[word] = to
            want = lm.likelihood(counts(moved)) - lm.likelihood(counts(classes))
            assert gain[to] - gain[own] == pytest.approx(want, abs=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    docs = documents(spark, SF_ORACLE)
    return lm.train(docs.select(F.col("text").cast("binary")))


def test_exchange_raises_the_likelihood(model):
    seen = model.likelihoods
    assert all(b >= a for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_probabilities_sum_to_one(spark, model):
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    kinds, n = len(model.mass), len(model.frequent)
    total = np.bincount(model.classes[:n], model.frequent_counts + 1.0, kinds)
    rare = {}
    for r in model.counts.collect():
        at = lm.CLASSES + 1 + lm.ending(bytes(r["word"]))
        rare[at] = rare.get(at, 0) + r["c"] + 1
    for at, mass in rare.items():
        total[at] += mass
    # the one left of every class is for its unknown words; the end has its class alone
    for c in set(range(kinds)) - {lm.CLASSES}:
        assert total[c] + 1 == pytest.approx(10 ** model.mass[c])
    assert model.mass[lm.CLASSES] == 0


def test_score_is_transitions_and_emissions(spark, model):
    """The score of a text, put together word by word."""
    rare = {bytes(r["word"]): r["c"] for r in model.counts.collect()}
    texts = [r.text for r in documents(spark, SF_ORACLE).limit(20).collect()] + ["neverseen Words", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.lit(False).alias("held_out"))
    got = {r.doc_id: r.score for r in lm.scores(rows, model).collect()}
    for i, text in enumerate(texts):
        before, want = lm.CLASSES, 0.0
        for word in lm.words_of(text.encode()):
            number = model.frequent.get(word)
            now = lm.CLASSES + 1 + lm.ending(word) if number is None else model.classes[number]
            c = rare.get(word, 0) if number is None else model.frequent_counts[number]
            want += model.transition[before, now] + math.log10(c + 1) - model.mass[now]
            before = now
        want += model.transition[before, lm.CLASSES]
        assert got[i] == pytest.approx(want)


def test_held_out_perplexity_is_below_the_base(spark):
    held = [r for r in lm.op13_class_lm(spark, SF_ORACLE).collect() if r.held_out]
    assert len(held) > 80
    size = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / size > sum(r.base_score for r in held) / size + 0.1


def test_frequent_words_are_bounded(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(50)]
    texts = frame(spark, rows).select(F.col("text").cast("binary"))
    assert len(lm.train(texts, share=100, rounds=1).frequent) <= 100
