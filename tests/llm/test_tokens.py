"""Token counts and byte-level BPE against the public libraries."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from mercato.llm import byte_bpe, token_counts
from mercato.llm.common import documents
from tests.conftest import SF_SMALL

EDGES = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n \n b", "a\n ", "x\t y \r\n z",
    "it's we'll they've I'D", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "ab" * 3000,
    "a" * 5000, "é" * 999, "\x00\x1c\x85", "漢字かな交じり文", "½²Ⅷ ١٢ _under_", "😀 😀😀", "ﬁne print",
    "word, word. word; word", " ", "a b",
]


def random_texts(n):
    pick = random.Random(5)
    alphabet = "abé  \n\t'sté漢١½_-%\x1c\x85 😀<|endoftext|>,."
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 80))) for _ in range(n)]


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as fh:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(),
                             special_tokens={})


def edge_table(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(EDGES)]
    rows += [(None, "null id", "x", 0), (900, None, "x", 0), (7, "again", "x", 0), (7, "again", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_counts_equal_the_library(spark, library):
    docs = documents(spark, SF_SMALL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in token_counts.op3_token_counts(spark, SF_SMALL).collect():
        want = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert row.n_tokens == want
        assert row.n_bytes == len(texts[row.doc_id].encode())
        assert row.over_limit == (want > 512)


def test_counts_of_edge_cases(spark, library):
    table = edge_table(spark)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(table).collect())
    want = sorted((str(r.doc_id), len((r.text or "").encode()),
                   len(library.encode(r.text or "", add_special_tokens=False).ids))
                  for r in table.collect())
    assert got == want
    assert token_counts.token_counts(table.limit(0)).count() == 0


def test_merging_equals_the_library_on_random_texts(library):
    table = token_counts.merger(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*EDGES, *random_texts(1500)]:
        assert table.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_encoding_equals_the_library_and_decodes(encoding):
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in [*EDGES, *random_texts(1500)]:
        ids = codec.encode(text)
        assert ids == encoding.encode_ordinary(text), ascii(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("first", range(0, 0x30000, 0x8000))
def test_every_character_splits_as_in_the_library(encoding, first):
    codec = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for code in range(first, first + 0x8000, 7):
        if not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1 {chr(code)}b"
            assert codec.encode(text) == encoding.encode_ordinary(text), hex(code)


def test_digests(spark, encoding):
    table = edge_table(spark)
    texts = [(str(r.doc_id), r.text or "") for r in table.collect()]
    want = sorted((i, len(ids := encoding.encode_ordinary(t)),
                   hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in byte_bpe.digests(table).collect())
    assert got == want
    assert byte_bpe.digests(table.limit(0)).count() == 0


def test_encode_and_decode_tables_are_a_round_trip(spark):
    docs = documents(spark, SF_SMALL)
    back = byte_bpe.decode(byte_bpe.encode(docs))
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert {r.doc_id: bytes(r.data) for r in back.collect()} == texts


def test_digest_query_on_given_table(spark, encoding):
    texts = {r.doc_id: r.text for r in documents(spark, SF_SMALL).collect()}
    rows = byte_bpe.op9_byte_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
