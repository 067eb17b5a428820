"""Packing: every id in one piece, pieces gapless in sequences, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mercato.llm import pretokens
from mercato.llm.common import documents
from mercato.llm.packing import IdBytes, op7_packing, packed_documents, shortest_pack_first
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_sequences(rows, length):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at and size > 0
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_pieces_and_sequences(spark, library):
    texts = {r.doc_id: r.text for r in documents(spark, SF_SMALL).collect()}
    rows = op7_packing(spark, SF_SMALL).collect()
    padding = check_sequences(rows, 1024)
    assert padding < 0.03 * sum(r.length for r in rows)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_edges(spark):
    rows = [(1, "", "x"), (2, None, "x"), (None, "no id", "x"), (3, "twice", "x"), (3, "twice", "x"),
            (4, "a<|endoftext|>b", "x"), (5, "long " * 4000, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packed_documents(table).collect()
    check_sequences(got, 1024)
    by_id = Counter(r.doc_id for r in got)
    assert by_id[3] == 2 and by_id[None] == 1 and by_id[5] > 3
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id in (1, 2)] == [(1, 1), (1, 1)]
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packed_documents(table.limit(0)).count() == 0


def test_odd_texts_have_the_ids_of_the_library(library):
    pick = random.Random(7)
    bits = ["a", "'s", "'song", "ll", " the", "the", "  ", " ", "\n", "\n\n", "\t", "é", "à", "Â", "\u00a0", " .", ".", ",",
            "12", "!!", "$$", "Ж", "漢", "ß", "ǅ", "\U0001F600", "x" * 70, "<|endoftext|>", "<|end"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for memo in (500_000, 10):
        assert list(IdBytes(public_tokenizers.path("byte_bpe_50k.json"), memo).texts(texts)) == want


def test_new_words_share_calls_of_the_model(library):
    class Counted:
        calls = 0

        def tokenize(self, sequence):
            self.calls += 1
            return library.model.tokenize(sequence)

    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}{'xyz'[j // 26]}{'q' * (i // 26)}" for j in range(78))
             + ".\nNext" for i in range(60)]
    tokenizer = IdBytes(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.model = Counted()
    got = list(tokenizer.texts(texts))
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len({w for t in texts for w in t.split()}) > 4000 and tokenizer.model.calls < 200


def test_words_at_marks_and_line_feeds_are_not_split_one_by_one(library, monkeypatch):
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefghijé") for _ in range(pick.randint(2, 9))) for _ in range(4000)]
    ends = ["", ",", ".", "!!", "?!", "...", "$$$", "%", "'", "_)", "*&"]
    texts = ["".join(w + pick.choice(ends) + pick.choice([" ", "\n", "\n "]) for w in words[at:at + 80]).strip(" ")
             for at in range(0, 4000, 80)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    calls, split = [], pretokens.split
    monkeypatch.setattr(pretokens, "split", lambda text: calls.append(text) or split(text))
    tokenizer = IdBytes(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(tokenizer.texts(texts)) == want
    assert len(calls) < 100


def test_texts_around_line_feeds_and_marks_have_the_ids_of_the_library(library):
    pick = random.Random(11)
    bits = ["a", "Next", "é", "7", "x" * 70, "'s", "'", "'ll", ".", ",", "!!", "_", "\n", "\n", "\n\n", "\r", "\t", " ", " "]
    texts = ["", "\n", "\n\n", " ", ".", "\n.", "a\n"]
    texts += ["".join(pick.choice(bits) for _ in range(pick.randint(1, 12))) for _ in range(6000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for memo in (500_000, 40, 1):
        tokenizer = IdBytes(public_tokenizers.path("byte_bpe_50k.json"), memo)
        got = [ids for at in range(0, len(texts), 500) for ids in tokenizer.texts(texts[at:at + 500])]
        assert got == want
        assert len(tokenizer.words.words) == len(tokenizer.words.number) <= memo


def test_long_words_are_not_kept():
    tokenizer = IdBytes(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(5):
        list(tokenizer.texts([f"some words {'ab' * 50_000}{k} and more."]))
    assert len(tokenizer.words.data) < 100 and max(map(len, tokenizer.words.words)) < 64


def test_one_length_holds_nearly_all_rows(spark):
    table = spark.range(3000).selectExpr("id as doc_id", "if(id % 7 = 0, 'some more words', 'one') as text")
    got = packed_documents(table).collect()
    assert len(got) == 3000
    assert check_sequences(got, 1024) < 1024


@pytest.mark.parametrize("seed", range(20))
def test_patterns_hold_the_histogram(seed):
    pick = random.Random(seed)
    length = pick.choice([16, 100, 1024])
    histogram = {pick.randint(1, length): pick.randint(1, 10 ** pick.randint(0, 6)) for _ in range(40)}
    packs = shortest_pack_first(histogram, length)
    held = Counter()
    for count, pattern in packs:
        assert count > 0 and 0 < sum(pattern) <= length
        for size in pattern:
            held[size] += count
    assert held == histogram
