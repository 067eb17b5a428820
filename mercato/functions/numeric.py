"""Numeric column helpers that keep money exact.

Money is summed as decimal and only turned into double at the very end, so the
result does not depend on the order in which partial aggregates are merged.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundred() -> Column:
    """The literal 100.0 as decimal(4,1), so percentages stay exact."""
    return F.lit(Decimal("100.0"))


def round2(c: Column) -> Column:
    """round(x, 2), half away from zero, through a decimal(28,10) step.

    Going through decimal makes a double input round the way its decimal text
    reads (1.005 -> 1.01) and keeps decimal inputs exact.
    """
    return F.round(c.cast("decimal(28,10)"), 2)


def safe_div(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0): NULL instead of an ANSI division-by-zero error."""
    return num / F.nullif(den, F.lit(0))


def pct(num: Column, den: Column) -> Column:
    """round(100.0 * num / NULLIF(den, 0), 2) in exact decimal arithmetic."""
    return round2(safe_div(hundred() * num, den))


def exact_avg(c: Column) -> Column:
    """Average of a decimal column as sum / count with a wide result scale.

    ``F.avg`` on decimal(p,s) rounds at s+4 places before any later rounding;
    dividing the exact sum by the count keeps >= 17 places instead.
    """
    return safe_div(F.sum(c), F.count(c).cast("decimal(20,0)"))


def money_ratio(num: Column, den: Column) -> Column:
    """Unrounded ratio reported as a float (e.g. average order value)."""
    return safe_div(num.cast("double"), den.cast("double"))


def decimals_to_double(df):
    """Project every decimal column to double (the form the reports hand out)."""
    from pyspark.sql import types as T

    cols = [F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def hundredths_half_up(num: Column, den: Column) -> Column:
    """round(num / den, 2) * 100 as a long, half away from zero, exact.

    Integral division (SQL ``div``) keeps it in 64-bit arithmetic instead of
    arbitrary-precision decimals; callers keep |num| * 200 below 2**63.
    NULL when ``den`` is 0.
    """
    num, den = num.cast("long"), den.cast("long")
    q = F.call_function("div", F.abs(num) * 200 + den, F.nullif(den, F.lit(0)) * 2)
    return F.when(num < 0, -q).otherwise(q)


def from_hundredths(q: Column, precision: int) -> Column:
    """A long count of hundredths as decimal(precision, 2), exactly."""
    return (q.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast(f"decimal({precision},2)")
