"""Token counts by byte-pair merging with a heap over a linked list.

A stretch of text starts as one symbol per byte. A heap holds every adjacent
pair that the vocabulary can merge, keyed by (rank, position); the lowest is
popped, the two symbols are joined in the linked list and the two new
neighbouring pairs are pushed. A stretch of n symbols that took m merges has
n - m tokens; no identifiers are produced.
"""

from __future__ import annotations

import heapq
import json
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from mercato.llm import pretokens
from mercato.llm.common import acyclic, documents, held

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PairMerger:
    """Merge table of a byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path}: a byte-level BPE vocabulary is needed")
        vocab = model["vocab"]
        self.byte_symbol = [vocab[c] for c in pretokens.byte_alphabet()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        # Added tokens are cut out of a text first and count one each.
        added = sorted((t["content"] for t in spec.get("added_tokens") or ()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo = pretokens.ChunkMemo(self.merged, sum)

    def merged(self, stretch: str) -> int:
        """Tokens of one stretch: symbols minus merges."""
        symbols = [self.byte_symbol[b] for b in stretch.encode("utf-8")]
        n, merges = len(symbols), self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = merges[left, right][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((symbols[i], symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], symbols[i]))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], symbols[i]))
            done += 1
        return n - done

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.memo.text(text)
        return len(self.added.findall(text)) + sum(map(self.memo.text, self.added.split(text)))


def merger(path: str) -> PairMerger:
    """The merge table, loaded once per Python worker."""
    return held(("token_counts", path), lambda: PairMerger(path))


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens and whether the tokens exceed ``limit``.

    ``vocabulary`` is a byte-level ``tokenizers`` file that every worker can
    open (default: the public 50k file). A null or empty text has 0 bytes and
    0 tokens; a null id stays null; repeated rows are counted each; other
    columns are ignored; an empty table gives an empty result. One pass, no
    shuffle, whole texts.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches):
        table = merger(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8")) for t in texts]
            with acyclic():
                tokens = [table.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(count, SCHEMA)


def op3_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
