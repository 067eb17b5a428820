"""Primary-key assertion: the key must be unique and never NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyViolation(ValueError):
    """A dimension has a duplicated or NULL key."""


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once or are NULL (one row per offending key).

    A plain aggregation: partial counts are combined map-side, so a hot key
    costs one row per partition in the shuffle, not all of its rows.
    """
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) | F.col(key).isNull()))


def assert_primary_key(df: DataFrame, key: str, name: str) -> None:
    """Raise KeyViolation when ``key`` is not a primary key of ``df``.

    Only the first offender travels to the driver.
    """
    bad = key_violations(df, key).limit(1).collect()
    if bad:
        row = bad[0]
        raise KeyViolation(
            f"{name}: primary key {key} violated by {row[key]!r} ({row['n']} rows)")
