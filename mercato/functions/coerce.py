"""Turn text columns that hold only numbers back into numeric columns.

Report results travel as text (decimals are serialised as strings). A text
column becomes numeric only when every value converts; columns with any NULL,
NaN or non-numeric value stay text, and an empty input is left as it is. Whole
numbers become bigint if all of them fit, else double.
The decision needs one aggregation over the data (a few counters per column);
the casts are then a plain projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number as text: digits with an optional point and exponent, or infinity. Java's
# suffixes (12d, 5F) are no numbers.
_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_INTEGRAL = r"^\s*[+-]?\d+\s*$"


def numeric_plan(df: DataFrame) -> dict[str, str]:
    """{column: 'bigint' | 'double'} for the text columns that convert cleanly."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(text_cols):
        number = F.col(c).rlike(_NUMBER) & F.col(c).try_cast(T.DoubleType()).isNotNull()
        whole = F.col(c).rlike(_INTEGRAL) & F.col(c).try_cast(T.LongType()).isNotNull()
        aggs.append(F.count_if(number).alias(f"d{i}"))
        aggs.append(F.count_if(whole).alias(f"i{i}"))
    stats = df.agg(*aggs).first()
    rows = stats["_rows"]
    plan = {}
    if rows == 0:
        return plan
    for i, c in enumerate(text_cols):
        if stats[f"d{i}"] == rows:
            plan[c] = "bigint" if stats[f"i{i}"] == rows else "double"
    return plan


def coerce_numeric(df: DataFrame) -> DataFrame:
    plan = numeric_plan(df)
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c)
                       for c in df.columns])


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is NULL are left out (chart input)."""
    return df.na.drop(subset=[column])
