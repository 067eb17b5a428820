"""The pipeline's stages, each against what it promises, and its whole run."""

import pathlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from mercato.llm.common import documents
from mercato.session import checkpoint_dir
from tests.conftest import SF_SMALL
from tests.llm.test_ngrams import brute, gram_sets
from tests.llm.test_packing import check_sequences

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_stages_are_named_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "packing"]


def test_language_stage_keeps_clean_documents(spark):
    docs = documents(spark, SF_SMALL)
    odd = spark.createDataFrame([(-1, "12 34 !!", "en", "s", 8), (-2, None, "en", "s", 0)], docs.schema)
    kept = stage("language_id")(spark, docs.unionByName(odd), SF_SMALL)
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    docs = documents(spark, SF_SMALL)
    more = spark.createDataFrame(
        [(5000, "a b c d e f g", "en", "s", 1), (5000, "a b c d e f g", "en", "s", 1),
         (None, "a b c d e f g", "en", "s", 1), (None, "no id at all in this one", "en", "s", 1),
         (None, "no id at all in this one", "en", "t", 1), (5001, "", "en", "s", 0),
         (5002, None, "en", "s", 0), (5003, "first of two texts", "en", "s", 0),
         (5003, "and quite another text here", "en", "s", 0)], docs.schema)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [i for i, _, c in brute(rows, 5, 80, 100) if i == c]
    got = stage("near_duplicates")(spark, docs.unionByName(more), SF_SMALL).collect()
    ids = [r.doc_id for r in got]
    assert sorted(i for i in ids if i is not None and i < 5000) == want
    assert ids.count(5000) == 1 and ids.count(None) == 1
    assert {5001, 5002} <= set(ids) and ids.count(5003) == 2
    assert not set(ids) - set(want) - {5000, 5001, 5002, 5003, None}


def test_secret_stage_changes_only_texts_with_secrets(spark):
    docs = documents(spark, SF_SMALL)
    before = {r.doc_id: r for r in docs.collect()}
    after = stage("secrets")(spark, docs, SF_SMALL)
    assert after.columns == COLUMNS
    for r in after.collect():
        planted = re.search(r'(?i)token = "[0-9a-f]{40}"', before[r.doc_id].text)
        if not planted:
            assert r.text == before[r.doc_id].text
        assert not re.search(r'(?i)token = "[0-9a-f]{40}"', r.text) and r.n_chars == len(r.text)


def test_whole_run_packs_every_kept_text(spark):
    docs = documents(spark, SF_SMALL)
    for name, run in pipeline.STAGES[:-1]:
        docs = run(spark, docs, SF_SMALL)
    kept = {r.doc_id: r.text for r in docs.collect()}
    sets = gram_sets(kept.values(), 5)
    assert len(kept) < documents(spark, SF_SMALL).count() and all(sets)
    rows = pipeline.run(spark, SF_SMALL).collect()
    check_sequences(rows, 1024)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = {i: sum(r.length for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}}
    assert got == want
    assert np.array([r.doc_tokens for r in rows]).max() == max(want.values())


def test_empty_table_passes_through(spark):
    docs = documents(spark, SF_SMALL).limit(0)
    for _, run in pipeline.STAGES:
        docs = run(spark, docs, SF_SMALL)
    assert docs.count() == 0


def test_small_results_are_written_in_few_files(spark):
    """However many shuffle partitions a session has: every file may cost an
    executor a process (five words are said twice, so all stages have rows)."""
    docs = spark.createDataFrame(
        [(i, f"the brown fox number {i // 2} jumps over dog {i // 2} and cat {i // 2}", "en", "s", 9)
         for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"), "mercato-llm")
    before = set(folder.glob("*"))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        kept = stage("near_duplicates")(spark, docs, SF_SMALL)
        assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == list(range(0, 120, 2))
        packed = stage("packing")(spark, docs, SF_SMALL)
        assert packed.rdd.getNumPartitions() == 1 and packed.count() == 120
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = {f.name.rsplit("-", 1)[0]: len(list(f.glob("part-*"))) for f in set(folder.glob("*")) - before}
    shuffled = {k: n for k, n in files.items() if k in ("buckets", "ids", "pairs", "cc", "groups", "repeated")}
    assert {"buckets", "ids", "groups"} <= set(shuffled) and max(shuffled.values()) == 1
