"""Text expressions used on submitted SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace characters trimmed from both ends (the \s class of Java regex;
# F.trim alone only removes blanks).
WHITESPACE = " \t\n\u000b\f\r"
# Markdown code fence at the start (optionally tagged sql) or at the end.
_FENCE = r"(?i)^```(?:sql)?\s*|\s*```$"


def strip_blanks(c: Column) -> Column:
    """Remove leading and trailing whitespace, newlines included."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_sql_text(c: Column) -> Column:
    """Strip Markdown fences and surrounding blanks from generated SQL text."""
    return strip_blanks(F.regexp_replace(strip_blanks(c), _FENCE, ""))
