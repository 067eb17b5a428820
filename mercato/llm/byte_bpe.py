"""Byte-level BPE encoding and decoding in linear time.

The bytes of a stretch are mapped to Latin-1 characters, and pyahocorasick finds
the longest vocabulary token at the bytes that the encoder comes to. It walks
from left to right with these longest matches; a token
is accepted if it is compatible with the one before it, that is, if exact
merging of the two tokens' bytes gives the two tokens again. Otherwise the next
shorter token is tried, and where none is left the walk steps back and marks
the position as a dead end. A sequence whose adjacent tokens are all compatible
is the sequence that exact merging gives. Compatibility is memoised per pair,
so every position is visited a bounded number of times.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from mercato.llm import pretokens
from mercato.llm.common import BoundedMemo, acyclic, documents, held


class ByteBpe:
    """Encoder and decoder for a rank file (``token in base64, rank`` per line)."""

    def __init__(self, path: str):
        with open(path, "rb") as fh:
            ranked = [line.split() for line in fh if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in ranked}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.reach = max(map(len, self.ranks))
        # The longest token that encodes as itself, of a matched path of the vocabulary.
        self._longest = BoundedMemo(
            lambda path: path if self._whole[path] else self._find_shorter(path))
        self._shorter = BoundedMemo(self._find_shorter)
        self._compatible = BoundedMemo(
            lambda pair: self._merge(pair[0] + pair[1]) == [pair[0], pair[1]])
        self._whole = BoundedMemo(lambda token: token in self.ranks and self._merge(token) == [token])
        self.memo = pretokens.ChunkMemo(self._stretch, _joined, 600_000)

    def _merge(self, data: bytes) -> list[bytes]:
        """Exact merging of a short byte string: always the lowest-ranked pair."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _find_shorter(self, token: bytes) -> bytes | None:
        """The longest token that is a proper prefix of ``token`` and encodes as itself."""
        for size in range(len(token) - 1, 0, -1):
            prefix = token[:size]
            if self._whole[prefix]:
                return prefix
        return None

    def encode_stretch(self, data: bytes) -> list[int]:
        """Ids of one stretch; a stretch that is a token is that token."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        ranks, shorter, compatible = self.ranks, self._shorter, self._compatible
        matched, longest, reach = self.automaton.longest_prefix, self._longest, self.reach
        n = len(data)
        text = data.decode("latin-1")
        dead = bytearray(n + 1)
        path: list[bytes] = [b""]
        at = 0
        token = longest[data[:matched(text[:reach])]]
        while at < n:
            last = path[-1]
            while token is not None and (dead[at + len(token)]
                                         or not (at == 0 or compatible[last, token])):
                token = shorter[token]
            if token is not None:
                path.append(token)
                at += len(token)
                if at < n:
                    token = longest[data[at:at + matched(text[at:at + reach])]]
            elif at:
                dead[at] = 1
                at -= len(path.pop())
                token = shorter[last]
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return [ranks[t] for t in path[1:]]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for stretch in pretokens.split(text):
            ids += self.encode_stretch(stretch.encode("utf-8"))
        return ids

    def decode(self, ids) -> bytes:
        """The bytes of the tokens, joined."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def _stretch(self, stretch: str) -> tuple[str, bytes]:
        """(ids in decimal, each followed by a space; the bytes decoded from them)."""
        ids = self.encode_stretch(stretch.encode("utf-8"))
        return "".join([f"{i} " for i in ids]), self.decode(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids and the SHA-256 of the ids and of the decoded bytes."""
        ids, decoded = self.memo.text(text)
        return (ids.count(" "), hashlib.sha256(ids[:-1].encode("ascii")).hexdigest(),
                hashlib.sha256(decoded).hexdigest())


def _joined(entries) -> tuple[str, bytes]:
    if not entries:
        return "", b""
    ids, decoded = zip(*entries)
    return "".join(ids), b"".join(decoded)


def codec(path: str) -> ByteBpe:
    """The vocabulary, loaded once per Python worker."""
    return held(("byte_bpe", path), lambda: ByteBpe(path))


def _path(vocabulary: str | None) -> str:
    return vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text.

    A null text counts as empty and has an empty list; ids may be null and
    rows may repeat; other columns are ignored. One pass, no shuffle.
    """
    path = _path(vocabulary)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            with acyclic():
                ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids",
           vocabulary: str | None = None) -> DataFrame:
    """(doc_id, data binary): the bytes that the ids stand for. A null list
    counts as empty; an id outside the vocabulary is an error."""
    path = _path(vocabulary)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            data = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(data, pa.binary())],
                names=["doc_id", "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str | None = None) -> DataFrame:
    """Per row: id, number of ids, SHA-256 of the ids and of the bytes decoded
    from them. Nulls, repeats and extra columns as in :func:`encode`."""
    path = _path(vocabulary)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            with acyclic():
                rows = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark, sf_dir):
    return digests(documents(spark, sf_dir))
