"""Language identification by interpolated Kneser-Ney character models.

Texts become symbols of a fixed alphabet of 64 (other characters than letters
are one boundary symbol, runs of it count once), so a four-gram is a 24-bit key
and a language's model has at most 2**24 entries whatever the corpus holds. All
four-grams of all learning rows are counted, per task first and then by one
shuffle of (language, key, count). The lower orders of Kneser-Ney smoothing are
continuation counts, which follow from the distinct four-grams alone.

Each language's model is a set of sorted key arrays with discounted
probabilities and back-off weights. A text goes to the language with the lowest
cross-entropy per symbol. Rejection is calibrated on the learning rows: a text
is rejected where its cross-entropy exceeds what its language's own texts have
by many standard deviations for its length, and lies nearer to that of random
symbols than to theirs (a passage in another language is no reason).
"""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import bounded_batches, documents, held, tidied

ORDER = 4
BITS = 6  # per symbol: an alphabet of 64
Z_REJECT = 8.0
UNDETERMINED = "und"
_SIZE = 1 << (BITS * ORDER)
_TABLE: list[np.ndarray] = []
SYMBOLS = 1 << 18  # counted at a time
SCORED = 1 << 16  # scored at a time
_CACHED_ROWS = 1 << 20  # four-grams whose probabilities a worker remembers


def _alphabet() -> np.ndarray:
    """Symbol of every code point: 0 for all but letters, 1-26 for a-z, and
    27-63 for other letters (by code point, so neighbours differ)."""
    if not _TABLE:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for code in range(sys.maxunicode + 1):
            char = chr(code)
            if char.isalpha():
                low = ord(char.lower()[0])
                table[code] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str | None) -> np.ndarray:
    """Keys of the text's four-grams, one for every symbol after the opening
    boundary; empty if the text has no letter."""
    symbols = _alphabet()[np.frombuffer((text or "").encode("utf-32-le"), "<u4")]
    if not symbols.any():
        return np.empty(0, np.int32)
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    symbols = symbols[keep]
    if symbols[0] == 0:
        symbols = symbols[1:]
    padded = np.zeros(len(symbols) + ORDER - 1, np.int32)
    padded[ORDER - 1:] = symbols
    keys = padded[:len(symbols)].copy()
    for i in range(1, ORDER):
        keys = keys << BITS | padded[i:i + len(symbols)]
    return keys


def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all learning rows, counted per task first."""
    def count(batches):
        counted: dict[str, list] = {}

        def merge(parts):
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, inverse, np.concatenate([p[1] for p in parts]))
            return keys, sums

        def close(lang):
            parts = counted.setdefault(lang, [])
            parts.append(np.unique(np.concatenate(open_grams.pop(lang)), return_counts=True))
            if len(parts) >= 16:
                counted[lang] = [merge(parts)]

        open_grams: dict[str, list] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(text)
                open_grams.setdefault(lang, []).append(found)
                sizes[lang] = sizes.get(lang, 0) + len(found)
                if sizes[lang] >= SYMBOLS:
                    close(lang)
                    sizes[lang] = 0
        for lang in list(open_grams):
            close(lang)
        for lang in sorted(counted):
            keys, sums = merge(counted[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)),
                 pa.array(sums)], names=["lang", "gram", "n"])

    learned = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                         & ~held_out(id_col))
    return (learned.select(F.col(lang_col).cast("string"), text_col)
            .mapInArrow(tidied(count), "lang string, gram int, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def kneser_ney(keys: np.ndarray, n: np.ndarray) -> list[dict]:
    """Orders 1 to 4 of a model: sorted keys with discounted probabilities,
    sorted contexts with back-off weights."""
    model = []
    order = np.argsort(keys)
    keys, n = keys[order].astype(np.int64), n[order].astype(np.float64)
    for size in range(ORDER, 0, -1):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts, start = np.unique(keys >> BITS, return_index=True)
        totals = np.add.reduceat(n, start)
        kinds = np.diff(np.append(start, len(keys)))
        model.append({
            "keys": keys, "prob": np.maximum(n - discount, 0) / np.repeat(totals, kinds),
            "contexts": contexts, "backoff": discount * kinds / totals})
        # In how many different contexts does the shorter gram stand?
        shorter = keys & ((1 << (BITS * (size - 1))) - 1)
        keys, n = np.unique(shorter, return_counts=True)
        n = n.astype(np.float64)
    return model[::-1]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def log_probabilities(model: list[dict], wanted: np.ndarray) -> np.ndarray:
    """log2 of the interpolated probability of each four-gram's last symbol."""
    probability = np.full(len(wanted), 1.0 / (1 << BITS))
    for size, order in enumerate(model, 1):
        key = wanted & ((1 << (BITS * size)) - 1)
        probability = (_find(order["keys"], order["prob"], key, 0.0)
                       + _find(order["contexts"], order["backoff"], key >> BITS, 1.0) * probability)
    return np.log2(probability)


class Scorer:
    """Cross-entropies of texts under every language, in one worker."""

    def __init__(self, models: dict[str, list[dict]]):
        self.langs = sorted(models)
        self.models = [models[lang] for lang in self.langs]
        # Row of a four-gram, from 1; 0: none. Few parts of the table are ever written, and
        # those that are not take no memory.
        self.index = np.zeros(_SIZE, np.int32)
        self.table = np.empty((0, len(self.langs)), np.float32)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        at = self.index[keys]
        if not at.all():
            new = np.unique(keys[at == 0]).astype(np.int64)
            if len(self.table) + len(new) > max(_CACHED_ROWS, len(new)):
                self.index = np.zeros(_SIZE, np.int32)
                self.table = self.table[:0]
                new = np.unique(keys).astype(np.int64)
            found = np.stack([log_probabilities(m, new) for m in self.models], axis=1)
            self.index[new] = np.arange(1, len(new) + 1) + len(self.table)
            self.table = np.concatenate([self.table, found.astype(np.float32)])
            at = self.index[keys]
        return self.table[at - 1]

    def entropies(self, texts: list[str | None]):
        """(symbols, cross-entropy per language, its mean square) for each text."""
        sizes = np.zeros(len(texts), np.int64)
        mean = np.zeros((len(texts), len(self.langs)))
        square = np.zeros_like(mean)
        waiting: list[tuple[int, np.ndarray]] = []

        def score():
            if not waiting:
                return
            part = np.array([i for i, _ in waiting])
            rows = self._rows(np.concatenate([g for _, g in waiting])).astype(np.float64)
            starts = np.cumsum(sizes[part]) - sizes[part]
            mean[part] = -np.add.reduceat(rows, starts, axis=0) / sizes[part][:, None]
            square[part] = np.add.reduceat(rows ** 2, starts, axis=0) / sizes[part][:, None]
            waiting.clear()

        held_symbols = 0
        for i, text in enumerate(texts):  # taken together up to a bounded number of symbols
            found = grams(text)
            sizes[i] = len(found)
            if len(found):
                waiting.append((i, found))
                held_symbols += len(found)
                if held_symbols >= SCORED:
                    score()
                    held_symbols = 0
        score()
        return sizes, mean, square


@dataclass
class LanguageModel:
    """A broadcast set of models and, per language, (mean, variance between
    texts, variance of a symbol) of the cross-entropy of its own texts."""

    name: str
    shared: object
    langs: list[str]
    usual: dict[str, tuple[float, float, float]]


def _scorer(name: str, shared) -> Scorer:
    return held(("language_id", name), lambda: Scorer(shared.value))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LanguageModel:
    """Learn a model from every row with a text and a language that is not held
    out. The driver gets the summed four-gram counts (at most 2**24 per
    language) and one row per language for the calibration."""
    spark = docs.sparkSession
    bounded_batches(spark)
    table = counts(docs, id_col, text_col, lang_col).toPandas()
    models = {lang: kneser_ney(part["gram"].to_numpy(), part["n"].to_numpy())
              for lang, part in table.groupby("lang", sort=True)}
    model = LanguageModel(uuid.uuid4().hex, spark.sparkContext.broadcast(models),
                          sorted(models), {})
    if not models:
        return model
    name, shared, langs = model.name, model.shared, model.langs

    def own(batches):
        at = {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            sizes, mean, square = _scorer(name, shared).entropies(batch.column(1).to_pylist())
            lang = batch.column(0).to_pylist()
            keep = [i for i in range(len(lang)) if sizes[i] and lang[i] in at]
            own_at = [at[lang[i]] for i in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang[i] for i in keep], pa.string()),
                 pa.array(mean[keep, own_at], pa.float64()),
                 pa.array(square[keep, own_at], pa.float64()),
                 pa.array(sizes[keep], pa.int64())], names=["lang", "h", "sq", "n"])

    learned = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                         & ~held_out(id_col))
    usual = (learned.select(F.col(lang_col).cast("string"), text_col)
             .mapInArrow(tidied(own), "lang string, h double, sq double, n long")
             .groupBy("lang").agg(
                 F.avg("h").alias("mean"), F.coalesce(F.var_pop("h"), F.lit(0.0)).alias("between"),
                 (F.sum(F.expr("(sq - h * h) * n")) / F.sum("n")).alias("within")))
    model.usual = {r["lang"]: (r["mean"], r["between"], r["within"]) for r in usual.collect()}
    return model


def _judge(model: LanguageModel, texts: list[str | None], z: float):
    """(language, score, rejected) of each text."""
    if not model.langs:
        return [(UNDETERMINED, 0.0, True)] * len(texts)
    sizes, mean, _ = _scorer(model.name, model.shared).entropies(texts)
    out = []
    best = mean.argmin(axis=1)
    # The advantage per symbol counts as evidence for up to 64 symbols.
    odds = np.exp2(-(mean - mean.min(axis=1, keepdims=True)) * np.minimum(sizes, 64)[:, None])
    for i in range(len(texts)):
        if not sizes[i]:
            out.append((UNDETERMINED, 0.0, True))
            continue
        lang = model.langs[best[i]]
        usual, between, within = model.usual.get(lang, (float("inf"), 0.0, 0.0))
        limit = max(usual + z * (between + within / sizes[i]) ** 0.5, (usual + BITS) / 2)
        out.append((lang, float(1.0 / odds[i].sum()), bool(mean[i, best[i]] > limit)))
    return out


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id",
             text_col: str = "text", z_reject: float = Z_REJECT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    A null text or one without a letter is ``und`` with score 0 and rejected
    (so is every text if nothing could be learned). Ties go to the language
    that sorts first. Null ids stay null, repeated rows are judged each, other
    columns are ignored.
    """
    def run(batches):
        for batch in batches:
            rows = _judge(model, batch.column(2).to_pylist(), z_reject)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1),
                 pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long"), held_out(id_col).alias("held_out"),
                       text_col).mapInArrow(
        tidied(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text",
             z_reject: float = Z_REJECT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is accepted."""
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])

    def run(batches):
        for batch in batches:
            rows = _judge(model, batch.column(at).to_pylist(), z_reject)
            yield batch.filter(pa.array([not r[2] for r in rows], pa.bool_()))

    return docs.mapInArrow(tidied(run), schema)


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
