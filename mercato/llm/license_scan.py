"""License scans by diagonal voting, in DataFrame operations only.

Every text is cut into lower-cased words and every pair of neighbouring words
is hashed. All of these rolling hashes are joined to the positions of the same
word pairs in the templates (a short fixed list, so it is broadcast), with the
words themselves as part of the join condition. A match votes for the diagonal
(word position minus template position); votes are kept as one bit per
template position. A phrase stands where one diagonal has all its votes. For
longer templates, neighbouring diagonals (a word added or left out) are merged
and a span counts as verified from a share of the template's pairs on.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import documents

# Phrases (label, words) of which every place is reported.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# License statements (label, text), found also with small changes.
STATEMENTS = [
    ("agpl-3.0", "GNU Affero General Public License version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-3.0", "GNU Lesser General Public License version 3"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Diagonals at most this far apart belong to one span.
NEIGHBOUR = 2
# Share of a statement's word pairs that a verified span has at least.
COVERAGE = 0.85
_MAX_TEMPLATE_WORDS = 63  # votes are bits of a long
_DOCUMENT = -1  # template number of the marker row that every text has


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pair_hash(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def template_tables(spark: SparkSession, phrases=None, statements=None):
    """(word pairs, templates): one row per word pair of every template and the
    marker's row; one row per template with its label and number of pairs."""
    rows, about = [], [(_DOCUMENT, None, False, 0)]
    given = [*((label, text, True) for label, text in (PHRASES if phrases is None else phrases)),
             *((label, text, False) for label, text in
               (STATEMENTS if statements is None else statements))]
    for number, (label, text, phrase) in enumerate(given):
        parts = re.findall(WORD, text.lower())
        if not 2 <= len(parts) <= _MAX_TEMPLATE_WORDS:
            raise ValueError(f"a template has 2 to {_MAX_TEMPLATE_WORDS} words: {text!r}")
        rows += [(a, b, number, i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        about.append((number, label, phrase, len(parts) - 1))
    rows.append(("", "", _DOCUMENT, 0))
    pairs = spark.createDataFrame(rows, "t_first string, t_second string, template int, at int")
    return (pairs.withColumn("t_hash", pair_hash(F.col("t_first"), F.col("t_second"))),
            spark.createDataFrame(about, "template int, label string, phrase boolean, pairs int"))


def votes(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text, template and diagonal with the template positions that
    voted (as bits); the marker rows count how often a text stands in the table."""
    cut = docs.select(F.col(id_col).alias("doc_id"),
                      F.xxhash64(text_col).alias("text_hash"),
                      words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    marker = F.array(F.struct(pair_hash(F.lit(""), F.lit("")).alias("h"),
                              F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = F.transform("words", lambda w, i: F.struct(
        pair_hash(w, F.get("words", i + 1)).alias("h"), w.alias("a"),
        F.coalesce(F.get("words", i + 1), F.lit("")).alias("b")))
    rolled = (cut.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
                         F.posexplode(F.concat(marker, pairs)).alias("pos", "pair"))
              .select("doc_id", "text_hash", "n_words", "pos", "pair.h", "pair.a", "pair.b"))
    met = rolled.join(F.broadcast(templates), (F.col("h") == F.col("t_hash"))
                      & (F.col("a") == F.col("t_first")) & (F.col("b") == F.col("t_second")))
    return met.groupBy("doc_id", "text_hash", "n_words", "template",
                       (F.col("pos") - 1 - F.col("at")).cast("long").alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("bits"), F.count(F.lit(1)).alias("n"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=None,
         statements=None, coverage: float = COVERAGE) -> DataFrame:
    """Licenses named in every text.

    Returns doc_id, n_words, n_base (places of the phrases), first_word and
    last_word (smallest and largest start of such a place, from 0; null
    without one), base_labels, labels (with those of verified statements) and
    score (1 with a place, else the best share of a statement's word pairs).
    A null or empty text has no words and no labels; a null id stays null;
    repeated rows give a row each; other columns are ignored; an empty table
    gives an empty result.
    """
    key = ["doc_id", "text_hash", "n_words"]
    pairs, about = template_tables(docs.sparkSession, phrases, statements)
    found = votes(docs, pairs, id_col, text_col).join(F.broadcast(about), "template")
    # Merge neighbouring diagonals of a statement into spans.
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    numbered = (found.withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(along))
                .withColumn("span", F.sum(F.when(F.col("phrase") | F.col("gap").isNull()
                                                 | (F.col("gap") > NEIGHBOUR), 1).otherwise(0))
                            .over(along)))
    spans = numbered.groupBy(*key, "template", "label", "phrase", "pairs", "span").agg(
        F.min("diagonal").alias("start"), F.expr("bit_or(bits)").alias("bits"),
        F.sum("n").alias("n"))
    share = F.try_divide(F.bit_count("bits"), F.col("pairs"))
    place = F.col("phrase") & (F.bit_count("bits") == F.col("pairs"))
    statement = ~F.col("phrase") & (share >= coverage)
    joined = lambda *sets: F.array_join(F.array_sort(reduce(F.array_union, sets)), ",")
    result = spans.groupBy(*key).agg(
        F.sum(F.when(F.col("template") == _DOCUMENT, F.col("n"))).alias("copies"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(place, F.col("label"))).alias("base"),
        F.collect_set(F.when(statement, F.col("label"))).alias("stated"),
        F.max(F.when(place, F.lit(1.0)).when(~F.col("phrase"), share)).alias("best"))
    return result.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("base"), F.col("stated")).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"), "copies",
    ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(
        "copies", "copy")


def op8_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir))
