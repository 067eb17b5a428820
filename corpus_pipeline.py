"""A training corpus from ``documents``, stage by stage.

language_id -> near_duplicates -> secrets -> packing. Every stage takes
(spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes to the
shared checkpoint folder and reads again as the next stage's ``docs``. All but
the last return the columns of ``documents``; the last returns the packed
pieces. A null or empty text has no language and goes in the first stage;
repeated rows are near duplicates of each other, of which the second stage
keeps one; an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import checkpointed, documents, matching
from mercato.llm.language_id import accepted, train
from mercato.llm.ngram_join import row_key, similarity_groups
from mercato.llm.packing import packed_documents
from mercato.llm.secret_scan import redacted, scan

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
# Chunks remembered while packing: few, as executors come to this stage with the
# memory that the stages before have grown them to.
PACKING_MEMO = 20_000

# Kneser-Ney scores, the random forest and the tokeniser are beyond SQL; the
# pipeline is tested against its operators and brute force instead.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models accept, learned from the
    labelled rows of ``docs``."""
    return accepted(docs, train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest
    id (null ids last; of rows that repeat an id, by a hash of the text; of
    equal rows, one). Documents without words are no duplicates."""
    total = docs.count()
    groups = checkpointed(similarity_groups(
        docs, k=SHINGLE_WORDS, num=SIMILARITY_PERCENT, den=100), "groups", total).where("group is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = (groups.groupBy("group").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("group", F.col("k.row_key").alias("first_key")))
    gone = groups.join(first, "group").where("row_key <> first_key").select(
        F.col("row_key").alias("__key"))
    kept = matching(docs.withColumn("__key", row_key("doc_id", "text")), gone, "__key", "left_anti",
                    total)
    repeated = checkpointed(groups.groupBy(F.col("row_key").alias("__key")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("__key"), "repeated", total)
    if not repeated.isEmpty():
        kept = matching(kept, repeated, "__key", "left_anti", total).unionByName(
            matching(kept, repeated, "__key", rows=total).dropDuplicates(["__key"]))
    return kept.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark and n_chars counted anew."""
    return redacted(docs, scan(docs)).withColumn("n_chars", F.length("text").cast("long")).select(
        *docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents, packed into sequences of 1,024 ids."""
    return packed_documents(docs, memo=PACKING_MEMO)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
