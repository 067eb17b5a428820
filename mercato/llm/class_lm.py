"""Language-model scores from Brown classes: class transitions and word emissions.

All words of all learning rows are counted by a shuffle. Words that make up at
least one in ``SHARE`` of the learning tokens (so at most ``SHARE`` words,
whatever the corpus holds) get their class by exchange clustering; every rarer
word, seen or not, has the class of its ending; the end of a text is a class of
its own. Counts of neighbouring symbols (frequent words, endings, the end) are
gathered once. In each round of the exchange the class bigram counts are summed
from them, and tasks then find, word by word, the class that raises the
likelihood most,

    sum N(c, d) log N(c, d) - 2 sum N(c) log N(c).

Words are dealt to parts. A part's words move one after the other, each seeing
the moves before it; parts do not see each other's. Where a round lowers the
likelihood it is undone, and fewer parts move in one. A text's score is the sum of log10 P(class | class before) + log10
P(word | class): transitions are smoothed towards the class frequencies (Witten
and Bell), emissions by one count per known word and one for all unknown ones.

Scoring needs the counts of a text's rare words. Texts are cut to chunks of
some hundred documents; a chunk asks once for each of its rare words, the
requests meet the counts in a join on the word, and the answers meet the chunk.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import checkpointed, documents, tidied

SHARE = 1 << 16
LONGEST = 64  # bytes of a word with a class of its own
CLASSES = 64  # by exchange
ENDINGS = 64  # classes of rarer words
ROUNDS = 8
PARTS = 8  # of the frequent words
CHUNK = 1 << 19  # tokens of a chunk (one document at least)
PAIRS = 1 << 21  # neighbouring symbols counted at a time
SLICE = 1 << 20  # bytes of texts split at a time (one text at least)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text (UTF-8), A-Z lower-cased, without the end."""
    return (text or b"").translate(_LOWER).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def slices(batch: pa.RecordBatch, column: int) -> list[pa.RecordBatch]:
    """The rows of a batch, cut at about every ``SLICE`` bytes of a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    of = (np.cumsum(sizes) - sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(sizes)]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """:func:`words_of` all texts (binary), one after the other, and where each
    text's begin, with the end."""
    # these kernels look at single bytes, whatever the encoding
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    kept = pc.not_equal(pc.binary_length(words), 0)  # spaces around a text leave empty words
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(False))])
    if before[-1] < len(words):
        words, offsets = words.filter(kept), before[offsets]
    return words.view(pa.binary()), offsets


def distinct(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and the number of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_numpy(False).tolist(), coded.indices.to_numpy()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, c): every word of the one-column table ``texts``."""
    def count(batches):
        held, size = [], 0

        def out():
            found = pa.chunked_array(held, pa.binary()).combine_chunks().value_counts()
            words = found.field("values")
            return pa.RecordBatch.from_arrays(
                [words, pa.array(map(ending, words.to_numpy(False).tolist()), pa.int32()), found.field("counts")],
                names=["word", "ending", "c"])

        for batch in batches:
            for part in slices(batch, 0):
                words, _ = split(part.column(0))
                held.append(words)
                size += len(words)
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return (texts.mapInArrow(tidied(count), "word binary, ending int, c long")
            .groupBy("word", "ending").agg(F.sum("c").alias("c")))


class _Symbols(dict):
    """Numbers of words: frequent ones have theirs, others by their ending
    (remembered for a while)."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.rare = len(frequent) + 1

    def __missing__(self, word):
        if len(self) > 1 << 19:
            for old in list(self)[self.rare - 1:]:
                del self[old]
        number = self[word] = self.rare + ending(word)
        return number


def neighbours(texts: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(a, b, n): how often symbol b follows a. Symbols are the numbers of
    frequent words, then the end (which also comes before a text), then endings."""
    end = len(frequent)
    symbols = end + 1 + ENDINGS

    def count(batches):
        number = _Symbols(frequent)
        held, size = [], 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            a, b = np.divmod(codes, symbols)
            for start in range(0, len(codes), 1 << 16):
                part = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[part], pa.int32()), pa.array(b[part], pa.int32()),
                     pa.array(n[part], pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                words, offsets = split(part.column(0))
                different, code = distinct(words)
                texts_here = len(offsets) - 1
                line = np.full(len(code) + texts_here + 1, end, np.int64)  # an end before and after each text
                place = np.arange(1, len(code) + 1) + np.repeat(np.arange(texts_here), np.diff(offsets))
                line[place] = np.fromiter(map(number.__getitem__, different), np.int64, len(different))[code]
                held.append(line[:-1] * symbols + line[1:])
                size += len(line) - 1
                if size >= PAIRS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return (texts.mapInArrow(tidied(count), "a int, b int, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def contexts(pairs: DataFrame) -> DataFrame:
    """One row per symbol: those after it and before it with their counts. A
    symbol has at most as many neighbours as there are symbols."""
    both = (pairs.select(F.col("a").alias("w"), F.lit(True).alias("after"), F.col("b").alias("other"), "n")
            .unionByName(pairs.select(F.col("b").alias("w"), F.lit(False).alias("after"),
                                      F.col("a").alias("other"), "n")))

    def pack(table: pa.Table) -> pa.Table:
        after = table["after"].to_numpy().astype(bool)
        other, n = table["other"].to_numpy().astype("<i4"), table["n"].to_numpy().astype("<i8")
        parts = [x[side].tobytes() for side in (after, ~after) for x in (other, n)]
        return pa.table({"w": table["w"][:1], **{c: pa.array([p], pa.binary()) for c, p in zip(
            ("after", "n_after", "before", "n_before"), parts)}})

    packed = both.groupBy("w").applyInArrow(
        pack, "w int, after binary, n_after binary, before binary, n_before binary")
    # a part's words lie together, commonest first
    return (packed.withColumn("part", F.col("w") % PARTS).repartition(PARTS, "part")
            .sortWithinPartitions("part", "w"))


def _context(row) -> tuple:
    return (np.frombuffer(row["after"], "<i4"), np.frombuffer(row["n_after"], "<i8"),
            np.frombuffer(row["before"], "<i4"), np.frombuffer(row["n_before"], "<i8"))


def class_counts(around: DataFrame, classes: np.ndarray, kinds: int) -> np.ndarray:
    """N(c, d): how often class d follows class c."""
    def add(batches):
        total = np.zeros((kinds, kinds), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                after, n, _, _ = _context(row)
                np.add.at(total[classes[row["w"]]], classes[after], n)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()),
                                          pa.array(total[c, d], pa.int64())], names=["c", "d", "n"])

    out = np.zeros((kinds, kinds), np.int64)
    for row in around.mapInArrow(add, "c int, d int, n long").groupBy("c", "d").agg(
            F.sum("n").alias("n")).collect():  # kinds * kinds rows at most
        out[row["c"], row["d"]] = row["n"]
    return out


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(counts: np.ndarray) -> float:
    return float(_h(counts.astype(float)).sum() - _h(counts.sum(axis=1).astype(float)).sum()
                 - _h(counts.sum(axis=0).astype(float)).sum())


def gains(counts: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: int,
          choices: int) -> np.ndarray:
    """What the likelihood gains where a word goes to each of ``choices`` classes,
    against being in none. ``after`` and ``before`` count its neighbours by
    class, itself included in class ``own``; ``itself`` counts it beside itself."""
    rest = counts.astype(float)
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] += itself
    after, before = after.astype(float), before.astype(float)
    after[own] -= itself
    before[own] -= itself
    # what its neighbours have beside it counts for their own classes anyway
    left, right = (rest.sum(axis=1) + before)[:choices], (rest.sum(axis=0) + after)[:choices]
    at = np.flatnonzero(after)
    rows = rest[:choices][:, at]
    gain = (_h(rows + after[at]) - _h(rows)).sum(axis=1)
    at = np.flatnonzero(before)
    columns = rest[at][:, :choices]
    gain += (_h(columns + before[at][:, None]) - _h(columns)).sum(axis=0)
    # the cell (b, b) takes both and the word beside itself
    cell = np.diagonal(rest)[:choices]
    a, b = after[:choices], before[:choices]
    gain += _h(cell + a + b + itself) - _h(cell + a) - _h(cell + b) + _h(cell)
    return (gain - _h(left + after.sum() + itself) + _h(left)
            - _h(right + before.sum() + itself) + _h(right))


def moves(around: DataFrame, classes: np.ndarray, counts: np.ndarray, words: int, choices: int,
          turn: int, groups: int) -> dict[int, int]:
    """New classes of words that are likelier elsewhere, of every ``groups``-th part."""
    kinds = len(counts)

    def find(batches):
        part, kind, total = None, classes, counts
        for batch in batches:
            w, to = [], []
            for row in batch.to_pylist():
                word = row["w"]
                if row["part"] != part:
                    part, kind, total = row["part"], classes.copy(), counts.copy()
                after, n_after, before, n_before = _context(row)
                follow = np.bincount(kind[after], n_after, kinds).astype(np.int64)
                precede = np.bincount(kind[before], n_before, kinds).astype(np.int64)
                itself, own = int(n_after[after == word].sum()), int(kind[word])
                gain = gains(total, own, follow, precede, itself, choices)
                best = int(gain.argmax())
                if gain[best] <= gain[own] + 1e-6:
                    continue
                total[own] -= follow
                total[:, own] -= precede
                total[own, own] += itself
                follow[own] -= itself
                precede[own] -= itself
                total[best] += follow
                total[:, best] += precede
                total[best, best] += itself
                kind[word] = best
                w.append(word)
                to.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(to, pa.int32())],
                                             names=["w", "to"])

    mine = around.where((F.col("w") < words) & (F.col("part") % groups == turn % groups))
    # a row per frequent word at most
    return {row["w"]: row["to"] for row in mine.mapInArrow(find, "w int, to int").collect()}


def exchange(around: DataFrame, words: int, choices: int = CLASSES,
             rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all symbols, their bigram counts, and every round's likelihood."""
    kinds = choices + 1 + ENDINGS
    classes = np.concatenate([np.arange(words) % choices, np.arange(choices, kinds)]).astype(np.int32)
    counts = class_counts(around, classes, kinds)
    seen, groups = [likelihood(counts)], 1
    for turn in range(rounds):
        moved = moves(around, classes, counts, words, choices, turn, groups)
        tried = classes.copy()
        tried[list(moved)] = list(moved.values())
        tried_counts = class_counts(around, tried, kinds) if moved else counts
        if likelihood(tried_counts) >= seen[-1]:
            classes, counts = tried, tried_counts
        else:
            groups = min(2 * groups, PARTS)
        seen.append(likelihood(counts))
    return classes, counts, seen


@dataclass
class Model:
    """Frequent words with their counts and classes, class transitions, and the
    counts of all words as a table."""
    frequent: dict[bytes, int]
    frequent_counts: np.ndarray
    classes: np.ndarray
    transition: np.ndarray  # log10 P(d | c)
    mass: np.ndarray  # log10 of each class's tokens, words and one
    counts: DataFrame
    tokens: int
    distinct: int
    ends: int
    likelihoods: list[float]


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 P(d | c), smoothed towards how often d occurs at all."""
    kinds = len(counts)
    left = counts.sum(axis=1)
    alone = (counts.sum(axis=0) + 1) / (counts.sum() + kinds)
    follow = (counts > 0).sum(axis=1)
    back = np.where(left > 0, follow, 1)[:, None]
    return np.log10((counts + back * alone[None, :]) / (left[:, None] + back))


def train(texts: DataFrame, *, share: int = SHARE, choices: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """A model of the one-column table ``texts`` (UTF-8, binary; null is empty)."""
    vocabulary = checkpointed(word_counts(texts), "words")
    ends = texts.count()
    size = vocabulary.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()
    tokens, distinct = size["c"] + ends, size["n"] + (ends > 0)
    # c * share >= tokens holds for ``share`` words at most
    common = F.expr(f"cast(c as decimal(20,0)) * {share} >= {tokens} and octet_length(word) <= {LONGEST}")
    rows = sorted(vocabulary.where(common).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))
    frequent = {bytes(r["word"]): i for i, r in enumerate(rows)}
    frequent_counts = np.array([r["c"] for r in rows], np.int64)
    around = checkpointed(contexts(checkpointed(neighbours(texts, frequent), "neighbours")), "contexts")
    classes, counts, seen = exchange(around, len(frequent), choices, rounds)
    kinds = len(counts)
    mass, kept = np.zeros(kinds), classes[:len(frequent)]
    mass[:choices] = (np.bincount(kept, frequent_counts, choices) + np.bincount(kept, minlength=choices))[:choices]
    for row in vocabulary.where(~common).groupBy("ending").agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        mass[choices + 1 + row["ending"]] = row["c"] + row["n"]
    return Model(frequent, frequent_counts, classes, transitions(counts), np.log10(mass + 1),
                 vocabulary.where(~common).select("word", "c"), tokens, distinct, ends, seen)


class _Chunk(dict):
    """Numbers of a chunk's words: frequent ones have theirs, others follow."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.first = len(frequent)
        self.words: list[bytes] = []
        self.endings: list[int] = []

    def __missing__(self, word):
        number = self[word] = self.first + len(self.words)
        self.words.append(word)
        self.endings.append(ending(word))
        return number


_CHUNKS = ("chunk long, doc_ids array<long>, held array<boolean>, n array<long>, known array<long>, "
           "base array<double>, score array<double>, sizes array<int>, rare binary, times binary, "
           "words array<binary>")


def chunks(docs: DataFrame, model: Model) -> DataFrame:
    """Documents (id, text, held out) in chunks: what frequent words and classes
    give, and the rare words whose counts are still to come."""
    frequent, classes, transition, mass = model.frequent, model.classes, model.transition, model.mass
    n_frequent = len(frequent)
    end_class = len(mass) - ENDINGS - 1
    plus_one = np.log10(model.frequent_counts + 1.0)
    emitted = plus_one - mass[classes[:n_frequent]]
    end_base = float(np.log10(model.ends + 1.0))
    each = float(np.log10(model.tokens + model.distinct + 1.0))
    end_known = int(model.ends > 0)

    def cut(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        table, rows, size = _Chunk(frequent), [], 0

        def out():
            nonlocal made
            ids, held, n, known, base, score, sizes, rare, times = zip(*rows)
            made += 1
            columns = [[(task << 32) + made], [ids], [held], [n], [known], [base], [score], [sizes],
                       [np.concatenate(rare).astype("<i4").tobytes()],
                       [np.concatenate(times).astype("<i8").tobytes()], [table.words]]
            kinds = [pa.int64(), *map(pa.list_, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(),
                                                 pa.float64(), pa.int32())),
                     pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=[part.split()[0] for part in _CHUNKS.split(", ")])

        def add(doc_id, held, number, endings):
            often = number < n_frequent
            kind = np.full(len(number) + 2, end_class)
            inner = kind[1:-1]
            inner[often] = classes[number[often]]
            rare, back, times = np.unique(number[~often] - n_frequent, return_inverse=True, return_counts=True)
            inner[~often] = end_class + 1 + endings[rare][back]
            n = len(number) + 1
            score = (transition[kind[:-1], kind[1:]].sum() + emitted[number[often]].sum()
                     - mass[inner[~often]].sum())
            base = plus_one[number[often]].sum() + end_base - n * each
            rows.append((doc_id, held, n, int(often.sum()) + end_known, float(base),
                         float(score), len(rare), rare, times))

        for batch in batches:
            for part in slices(batch, 1):
                words, offsets = split(part.column(1))
                different, code = distinct(words)
                numbers = np.fromiter(map(table.__getitem__, different), np.int64, len(different))[code]
                endings_here = np.array(table.endings, np.int64)
                for doc_id, held, number in zip(part.column(0).to_pylist(), part.column(2).to_pylist(),
                                                np.split(numbers, offsets[1:-1])):
                    add(doc_id, held, number, endings_here)
                size += len(numbers) + len(part)
                if size >= CHUNK:
                    yield out()
                    table, rows, size = _Chunk(frequent), [], 0
        if rows:
            yield out()

    return docs.mapInArrow(tidied(cut), _CHUNKS)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every row of ``docs`` (id, text as binary, held out)."""
    parts = checkpointed(chunks(docs, model), "chunks")
    asked = parts.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word"))
    answers = asked.join(model.counts, "word").select("of", "at", "c")
    tokens = model.tokens

    def finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        rare, times = np.frombuffer(row["rare"], "<i4"), np.frombuffer(row["times"], "<i8")
        c = np.zeros(int(rare.max(initial=-1)) + 1, np.int64)
        c[found["at"].to_numpy()] = found["c"].to_numpy()
        of = np.repeat(np.arange(len(row["sizes"])), row["sizes"])
        more = np.bincount(of, times * np.log10(c[rare] + 1.0), len(row["sizes"]))
        known = np.bincount(of, times * (c[rare] > 0), len(row["sizes"])).astype(np.int64)
        n = len(row["n"])
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
            "n_tokens": pa.array(row["n"], pa.int64()), "n_known": pa.array(known + row["known"], pa.int64()),
            "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
            "base_score": pa.array(more + row["base"]), "score": pa.array(more + row["score"])})

    return parts.drop("words").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(finish, _RESULT)


def class_lm(docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text",
             share: int = SHARE, choices: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all rows of ``docs`` by a model learned from those where the
    condition ``learn`` holds (never null).

    A null or empty text is only its end (one token). Null ids stay null and
    repeated rows are learned from and scored each; other columns are ignored.
    A text is read whole, and is held whole with its words in one task. Without
    learning rows every token of the base has probability one, as the formula
    says, and no word is known. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       (~learn).alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("text"), share=share, choices=choices, rounds=rounds)
    return scores(rows, model)


def op13_class_lm(spark, sf_dir):
    """A null id has the empty text's checksum, 0, and is learned from."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return class_lm(documents(spark, sf_dir), F.crc32(name) % 7 != 2)
