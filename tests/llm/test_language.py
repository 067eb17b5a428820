"""Language ID: held-out accuracy, no leaks, rejection, the model's sums."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.llm.common import documents
from mercato.llm.language_id import (BITS, Scorer, accepted, grams, identify, kneser_ney,
                                     log_probabilities, op4_language_id, train)
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def model(spark):
    return train(documents(spark, SF_ORACLE))


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in documents(spark, SF_ORACLE).collect()}
    rows = op4_language_id(spark, SF_ORACLE).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"de", "en", "es", "fr"} for r in rows)
    assert sum(r.rejected for r in rows) == 0


def test_held_out_rows_are_not_learned_from(spark):
    docs = documents(spark, SF_ORACLE)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    changed = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn(
        "source", F.lit(None).cast("string"))
    first, second = train(docs), train(changed)
    assert first.langs == second.langs
    rows = lambda m, d: sorted(tuple(r) for r in identify(d, m).collect())
    assert rows(first, docs) == rows(second, changed)


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (4, "the"), (None, "the and of"), (5, "the and of"),
            (5, "the and of"), (6, "Съешь же ещё этих мягких французских булок, да выпей чаю"),
            (7, "漢字かな交じり文を書いている人がいる"), (8, "the and that " * 50_000)]
    table = spark.createDataFrame([(*r, "x", 0.5) for r in rows],
                                  "doc_id long, text string, lang_pred string, score double")
    got = {(r.doc_id, i): r for i, r in enumerate(identify(table, model).collect())}
    by_id = {k[0]: r for k, r in got.items()}
    assert len(got) == len(rows)
    for i in (1, 2, 3):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    for i in (4, None, 5, 8):
        assert by_id[i].lang_pred == "en" and not by_id[i].rejected
    assert by_id[6].rejected and by_id[7].rejected
    kept = accepted(table, model)
    assert kept.columns == table.columns and kept.count() == 5


def test_nothing_to_learn(spark):
    table = spark.createDataFrame([(0, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(table, train(table)).collect()] == ["und"]
    empty = train(table.limit(0))
    assert identify(table.limit(0), empty).count() == 0


def test_probabilities_sum_to_one():
    keys = np.concatenate([grams(t) for t in ("the theme of that", "and then", "there they are")])
    model = kneser_ney(*np.unique(keys, return_counts=True))
    for context in {int(k) >> BITS for k in keys} | {12345}:
        wanted = (context << BITS) + np.arange(1 << BITS)
        assert abs(np.exp2(log_probabilities(model, wanted)).sum() - 1) < 1e-9


def test_scorer_keeps_no_memory_for_grams_it_has_not_seen():
    texts = ["the quick brown fox", "jumps over the lazy dog", "über größe 12 !", None, "the quick"]
    keys = np.concatenate([grams(t) for t in texts])
    found, n = np.unique(keys, return_counts=True)
    scorer = Scorer({"en": kneser_ney(found, n)})
    sizes, mean, square = scorer.entropies(texts)
    assert (scorer.index != 0).sum() == len(found) == len(scorer.table)
    for i, text in enumerate(texts):
        bits = -log_probabilities(scorer.models[0], grams(text).astype(np.int64)).astype(np.float32)
        assert sizes[i] == len(bits)
        assert not len(bits) or np.allclose([mean[i, 0], square[i, 0]], [bits.mean(), (bits ** 2).mean()], 1e-5)
    script = ("import re; from mercato.llm.language_id import Scorer; s = Scorer({}); s.index[5] = 1;"
              "print(re.search(r'VmRSS:\\s+(\\d+)', open('/proc/self/status').read())[1])")
    base = script.replace("s = Scorer({}); s.index[5] = 1;", "")
    used = [int(subprocess.run([sys.executable, "-c", x], capture_output=True, check=True, text=True).stdout)
            for x in (base, script)]
    assert used[1] - used[0] < 32_000
