"""Packing token sequences by shortest-pack-first over the length histogram.

1. Every document is tokenised once; its ids plus a closing id are cut into
   pieces of the sequence length and one remainder, and the pieces (not the
   ids) are written to the shared checkpoint folder.
2. The histogram of piece lengths (at most one row per possible length) is
   the only input of the packing. Lengths are placed longest first, each into
   the pack with the most room left; a pack is a pattern of lengths with a
   count, so millions of equal sequences are one entry.
3. Patterns meet documents by rank: the k-th piece of a length takes the k-th
   slot of that length. Ranks are numbered inside (length, salt) groups plus
   the groups' offsets, so a length that holds most rows is spread out.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm import pretokens
from mercato.llm.common import BoundedMemo, acyclic, checkpointed, documents, few_files, held, tidied

SEQUENCE_LENGTH = 1024
CLOSING_ID = 0
SALTS = 128
MEMO = 500_000  # words whose ids a worker remembers
STRETCHES = 100_000  # other stretches, per generation
LONGEST = 64  # characters of a stretch that is merged with others
GROUP = 128  # stretches merged in one call
TEXTS = 1 << 20  # characters of texts that are handled at a time (one text at least)
FIRST = "\x01"  # before a text's first chunk, which has no space before it; no divided text holds it
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Remembers words' ids by number, in arrays.

    ``compute`` gives the ids of many new words, one after the other, and their
    numbers of ids; it is told how many are letters alone and, after those, how
    many are ``FIRST`` and letters. When ``limit`` words are passed, those that the fewest slices
    had are forgotten (of equal ones the older), down to half the limit. Words
    beyond ``LONGEST`` characters are computed every time.
    """

    def __init__(self, compute, limit: int):
        self.compute, self.limit = compute, limit
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.data, self.uses = np.empty(0, "<u4"), np.empty(0, np.int32)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct ``words`` has its ids: data, first, size."""
        listed = words.to_numpy(False).tolist()
        at = np.fromiter(map(self.number.get, listed, repeat(-1)), np.int64, len(listed))
        self.uses[at[at >= 0]] += 1
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.data, self.first[at], self.size[at]
        fresh = words.take(pa.array(new))
        letters = pc.utf8_is_alpha(pc.utf8_ltrim(fresh, FIRST)).to_numpy(False)
        kind = np.where(letters, pc.starts_with(fresh, FIRST).to_numpy(False), 2)
        kind[pc.utf8_length(fresh).to_numpy() >= LONGEST] = 3
        new = new[np.argsort(kind, kind="stable")]
        fresh = [listed[i] for i in new.tolist()]
        found, sizes = self.compute(fresh, *np.bincount(kind, minlength=4)[:2].tolist())
        at[new] = np.arange(len(self.first), len(self.first) + len(new))
        data = np.concatenate([self.data, found])
        first = np.concatenate([self.first, len(self.data) + np.cumsum(sizes) - sizes])
        size = np.concatenate([self.size, sizes])
        kept = np.count_nonzero(kind < 3)
        self._remember(fresh[:kept], data, first, size)
        return data, first[at], size[at]

    def _remember(self, words: list[str], data: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        held = len(self.words) + len(words)
        self.number.update(zip(words, range(len(self.words), held)))
        self.words += words
        self.uses = np.concatenate([self.uses, np.ones(len(words), np.int32)])
        if held < len(first):
            data, first, size = data[:first[held]].copy(), first[:held].copy(), size[:held].copy()
        self.data, self.first, self.size = data, first, size
        if held > self.limit:
            most = np.sort(np.argsort(self.uses, kind="stable")[held - self.limit // 2:])
            self.words = [self.words[i] for i in most.tolist()]
            self.number = dict(zip(self.words, range(len(self.words))))
            self.data, self.size, self.uses = _gathered(data, first[most], size[most]), size[most], self.uses[most] // 2
            self.first = np.cumsum(self.size) - self.size


class IdBytes:
    """Ids of texts as little-endian unsigned 32-bit integers, by ``tokenizers``.

    Arrow splits many texts at their spaces and line feeds, numbers the distinct
    chunks, takes the punctuation off their ends and numbers the distinct words.
    Those that are not remembered are merged together, so each costs its share
    of a call, and the texts' ids are gathered by number.
    """

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        alphabet = pretokens.byte_alphabet()
        self.shown = np.array([ord(c) for c in alphabet], "<u2")
        added = tokenizer.get_added_tokens_decoder()
        self.added_ids = {t.content: int(i).to_bytes(4, "little") for i, t in added.items()}
        longest_first = sorted(self.added_ids, key=len, reverse=True)
        self.added = (re.compile(f"({'|'.join(map(re.escape, longest_first))})")
                      if longest_first else None)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        space, feed = alphabet[32], alphabet[10]
        size = max(vocabulary.values(), default=-1) + 1
        self.spaced, self.feed = np.zeros(size, bool), np.zeros(size, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        self.feed[[i for token, i in vocabulary.items() if token == feed]] = True
        # whether the ids of a sequence depend on its bytes and the merges alone
        self.plain = vocabulary.keys() >= set(alphabet) and not any(getattr(self.model, option, None) for option in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.by_stretch = BoundedMemo(lambda s: self._ids(s).tobytes(), min(memo, STRETCHES))
        self.words = WordIds(self._new_words, memo)

    def _ids(self, stretch: str) -> np.ndarray:
        codes = self.shown[np.frombuffer(stretch.encode("utf-8"), np.uint8)]
        return np.array([t.id for t in self.model.tokenize(codes.tobytes().decode("utf-16-le"))], "<u4")

    def _together(self, stretches: list[str], mark: str, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches, one after the other, and their numbers of ids;
        ``GROUP`` merged as one sequence.

        Every stretch has ``mark`` before it (" " is its own first character, a
        line feed is put there), and nowhere else. Merges only join, so where as
        many tokens as there are stretches start with the space, or are the line
        feed, no merge went across, and each stretch has the ids that it has
        alone. Otherwise the group's are merged alone.
        """
        data, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        own = mark == " "
        for at in range(0, len(stretches), GROUP):
            group = stretches[at:at + GROUP]
            ids = self._ids("".join(group) if own else mark + mark.join(group))
            first = np.flatnonzero(marks[ids])
            if len(first) != len(group):
                each = [self._ids(s) for s in group]
                data += each
                sizes.append(np.array([len(ids) for ids in each]))
                continue
            data.append(ids if own else np.delete(ids, first))
            sizes.append(np.diff(first, append=len(ids)) - (not own))
        return np.concatenate(data), np.concatenate(sizes)

    def _learn(self, stretches: set[str]) -> None:
        """Remember what is not known yet of matches of the public pattern."""
        spaced, other, alone = [], [], []
        for s in self.by_stretch.unknown(stretches):
            if not self.plain or len(s) > LONGEST:
                alone.append(s)
            elif s.rfind(" ") == 0:
                spaced.append(s)
            elif " " in s or "\n" in s:
                alone.append(s)
            else:
                other.append(s)
        found = [(s, self._ids(s).tobytes()) for s in alone]
        for group, mark, marks in ((spaced, " ", self.spaced), (other, "\n", self.feed)):
            data, sizes = self._together(group, mark, marks)
            ends = (4 * np.cumsum(sizes)).tolist()
            data = data.tobytes()
            found += [(s, data[a:b]) for s, a, b in zip(group, [0, *ends], ends)]
        self.by_stretch.remember(found)

    def _new_words(self, words: list[str], spaced: int, unspaced: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and their numbers of ids. The first
        ``spaced`` are one match each with a space, the next ``unspaced`` without."""
        if not self.plain:
            spaced = unspaced = 0
        rest = words[spaced + unspaced:]
        data, sizes = zip(
            self._together([" " + word for word in words[:spaced]], " ", self.spaced),
            self._together([word[1:] for word in words[spaced:spaced + unspaced]], "\n", self.feed),
            self._stretches([pretokens.split(word[1:] if word[0] == FIRST else word if word == "\n" else " " + word)
                             for word in rest]))
        return np.concatenate(data), np.concatenate(sizes)

    def _stretches(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of matches, one after the other, and their numbers of ids."""
        self._learn(set(chain.from_iterable(found)))
        stretch = self.by_stretch.__getitem__
        ids = [b"".join(map(stretch, part)) for part in found]
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def texts(self, texts) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TEXTS:
                yield from self._texts(held)
                held, size = [], 0
        yield from self._texts(held)

    def _texts(self, texts: list[str]) -> list[bytes]:
        whole, divided = [], []  # stretches of a text, or the text with marks where it is split
        for text in texts:
            found = marked = None
            if self.added is not None and self.added.search(text):
                pass
            elif pretokens.undivided(text):
                found = pretokens.split(text)
            else:
                marked = FIRST + (text.replace("\n", " \n " + FIRST) if pretokens.single_feeds(text) else text)
            whole.append(found)
            divided.append(marked)
        chunks = pc.split_pattern(pa.array(divided, pa.string()), " ")
        coded = chunks.values.dictionary_encode()
        data, first, size = self._chunks(coded.dictionary)
        number = coded.indices.to_numpy()
        sizes = size[number]
        data = _gathered(data, first[number], sizes).tobytes()
        bounds = np.concatenate([[0], 4 * np.cumsum(sizes)])[chunks.offsets.to_numpy()].tolist()
        self._learn(set().union(*filter(None, whole)))
        stretch = self.by_stretch.__getitem__
        return [data[a:b] if marked is not None else self._with_added(text) if found is None
                else b"".join(map(stretch, found))
                for text, found, marked, a, b in zip(texts, whole, divided, bounds, bounds[1:])]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of the distinct ``chunks`` has its ids: data, first, size.
        Punctuation that ends a chunk after a letter or digit is a match of its own."""
        trimmed = pc.utf8_rtrim(chunks, string.punctuation)
        apart = pc.utf8_is_alnum(pc.utf8_slice_codeunits(trimmed, -1))
        words = pc.if_else(apart, trimmed, chunks)
        length = (pc.binary_length(chunks).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
        _, offsets, text = chunks.buffers()
        stops = np.frombuffer(offsets, np.int32)[chunks.offset + 1:chunks.offset + len(chunks) + 1]
        ends = _gathered(np.frombuffer(text or b"", np.uint8), stops - length, length)
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        ends = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(offsets), pa.py_buffer(ends)).dictionary_encode()
        words = words.dictionary_encode()
        data, first, size = self.words.find(words.dictionary)
        end_data, end_size = self._stretches([[end] if end else [] for end in ends.dictionary.to_pylist()])
        end_first = len(data) + np.cumsum(end_size) - end_size
        word, end = words.indices.to_numpy(), ends.indices.to_numpy()
        size = np.column_stack([size[word], end_size[end]])
        data = _gathered(np.concatenate([data, end_data]),
                         np.column_stack([first[word], end_first[end]]).ravel(), size.ravel())
        size = size.sum(axis=1)
        return data, np.cumsum(size) - size, size

    def _with_added(self, text: str) -> bytes:
        return b"".join(self.added_ids[part] if part in self.added_ids
                        else b"".join(map(self.by_stretch.__getitem__, pretokens.split(part)))
                        for part in self.added.split(text))


def _tokenizer(path: str, memo: int) -> IdBytes:
    return held(("packing", path, memo), lambda: IdBytes(path, memo))


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, length: int = SEQUENCE_LENGTH,
           closing_id: int = CLOSING_ID, memo: int = MEMO) -> DataFrame:
    """Every document's ids plus ``closing_id``, cut every ``length`` ids.

    ``memo`` trades a worker's memory for time; the result does not depend on it.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    closing = closing_id.to_bytes(4, "little")

    def cut(batches):
        tokenizer = _tokenizer(path, memo)
        for batch in batches:
            rows = []
            with acyclic():
                texts = tokenizer.texts(text or "" for text in batch.column(1).to_pylist())
                for doc_id, ids in zip(batch.column(0).to_pylist(), texts):
                    data = memoryview(ids + closing)
                    total = len(data) // 4
                    for start in range(0, total, length):
                        piece = data[4 * start:4 * (start + length)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidied(cut), _PIECES)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, list[int]]]:
    """[(count, pattern)]: packs of lengths that sum to at most ``length``.

    Longest lengths first; each goes into the pack with the most room left
    (the shortest pack), or opens a pack where none has room. Ties between
    packs of equal room go to the one made last, so the result is fixed by
    the histogram.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        room = max((r for r, packs in by_room.items() if packs), default=0)
        while left:
            while room >= size and not by_room[room]:
                room -= 1
            if room < size:
                # nothing has room: pieces of one size fill packs of their own
                per_pack = length // size
                whole, rest = divmod(left, per_pack)
                if whole:
                    by_room[length - per_pack * size].append((whole, [size] * per_pack))
                if rest:
                    by_room[length - rest * size].append((1, [size] * rest))
                break
            count, pattern = by_room[room].pop()
            used = min(count, left)
            if count > used:
                by_room[room].append((count - used, pattern))
            by_room[room - size].append((used, [*pattern, size]))
            left -= used
    return [pack for room in sorted(by_room) for pack in by_room[room]]


def slots(packs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the
    pieces of a length go, by their rank among the pieces of that length."""
    rows, taken, sequence = [], defaultdict(int), 0
    for count, pattern in packs:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], sequence, offset))
            taken[size] += count
            offset += size
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(cut: DataFrame, *, length: int = SEQUENCE_LENGTH, salts: int = SALTS) -> DataFrame:
    """Assign every piece of :func:`pieces` a sequence and an offset in it.

    An empty table gives an empty result. Repeated documents are packed each.
    Only the histogram (at most ``length`` rows) reaches the driver.
    """
    cut = checkpointed(cut.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int")),
        "pieces")
    group = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in
                 group.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(shortest_pack_first(histogram, length))
    by_salt = Window.partitionBy("length").orderBy("salt").rowsBetween(
        Window.unboundedPreceding, -1)
    base = group.select("length", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("base"))
    in_group = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (cut.withColumn("nth", F.row_number().over(in_group) - 1)
              .join(base, ["length", "salt"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("base") + F.col("nth")).alias("rank")))
    starts = table[:, 0] << 44 | table[:, 1]

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            slot = table[np.searchsorted(
                starts, batch.column("length").to_numpy() << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
                 pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                       "sequence_id", "offset"])

    return few_files(ranked.mapInArrow(tidied(place), _PACKED), sum(histogram.values()))


def packed_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``.

    One row per piece. A null or empty text has the closing id alone; a null
    id stays null; repeated rows are packed each; other columns are ignored.
    """
    return pack(pieces(docs, **options), length=options.get("length", SEQUENCE_LENGTH))


def op7_packing(spark, sf_dir):
    return packed_documents(documents(spark, sf_dir))
