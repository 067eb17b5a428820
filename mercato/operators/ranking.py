"""Ranking operators that never move an unbounded row set into one task.

``rank() OVER (ORDER BY v DESC)`` without PARTITION BY is a single-task
window in Spark. The operators here give the same numbers with every step
partitioned, in one lazy plan for all sizes:

* ``global_rank``: rank(v) = 1 + number of rows ordered strictly before v.
  Rows are first collapsed to distinct values with their multiplicity
  (partial aggregation absorbs hot values). A value's bucket is its sign,
  binary exponent and the next eight bits of its mantissa: a rule that needs
  no look at the data, keeps the order of values and gives equal values one
  bucket, so ties get one rank, exactly as SQL ``rank()``. Per-bucket totals
  give bucket offsets, and a window partitioned by bucket adds the count
  inside the bucket.
* ``top_k_ranked``: the first k rows by an ordered limit (each partition
  keeps k rows) and their rank computed inside that prefix, which equals the
  global rank because every row ordered before a prefix row is in the prefix.

Ordering follows the reference database: descending with NULLs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per power of two. The exponents of a double and the sign bound the
# number of buckets (about 1.05 million) whatever the table holds.
STEPS = 256
_EXPONENTS = 1100


def value_bucket(value: Column) -> Column:
    """An integer that does not fall as the value rises (NULL highest); equal for
    equal values."""
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    place = (exponent + _EXPONENTS) * STEPS + step
    return (F.when(value.isNull(), F.lit(1 << 40)).when(size == 0, F.lit(0))
            .otherwise(F.signum(value.cast("double")) * place).cast("long"))


def value_ranks_desc(df: DataFrame, value: str, out: str) -> DataFrame:
    """One row per distinct ``value`` (NULL included) with its descending rank.

    NULL comes first. The single-task step (the running total over buckets)
    sees one row per bucket, a number that the value's type bounds.
    """
    v = F.col(value)
    bucketed = (df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_bucket", value_bucket(v)))
    totals = bucketed.groupBy("_bucket").agg(F.sum("_n").alias("_t"))
    earlier = (Window.orderBy(F.col("_bucket").desc())
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_bucket", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    inside = (Window.partitionBy("_bucket").orderBy(v.desc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    return (bucketed.withColumn("_gt", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .join(offsets, "_bucket")
            .select(value, (F.lit(1) + F.col("_off") + F.col("_gt")).cast("long").alias(out)))


def global_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` plus ``out`` = rank() OVER (ORDER BY value DESC NULLS FIRST).

    Lazy: no job runs when it is defined. ``df`` feeds two branches, so a
    costly input should be a written table (the build writes it).
    """
    ranks = value_ranks_desc(df, value, out).withColumnRenamed(value, "_rv")
    return df.join(ranks, df[value].eqNullSafe(ranks["_rv"]), "inner").drop("_rv")


def order_desc(value: str, *tie_keys: str) -> list[Column]:
    return [F.col(value).desc_nulls_first()] + [F.col(k).asc_nulls_last() for k in tie_keys]


def top_k_ranked(df: DataFrame, value: str, k: int, out: str, *tie_keys: str) -> DataFrame:
    """The k first rows by ``value`` DESC (ties broken by ``tie_keys``) with rank."""
    if k < 1:
        raise ValueError(f"k must be positive, got {k}")
    prefix = df.orderBy(*order_desc(value, *tie_keys)).limit(k)
    w = Window.orderBy(F.col(value).desc_nulls_first())
    return prefix.withColumn(out, F.rank().over(w).cast("long"))
