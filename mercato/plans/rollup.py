"""Order-level rollup of the delivered lines, stored by the build.

One row per order and purchase date with the sums of its lines. Sums merge by
adding up. The number of distinct orders merges too, although raw orders may
repeat an id on several dates: every row carries the date of the order's row
before it (``previous_date``), and an order is counted in a period by its first
row there, the one whose previous row lies in another period or before the
range that is asked for. So no report has to move (period, order_id) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.dates import period_start
from mercato.plans.views import delivered_lines, with_running_growth

ORDER_DAYS = "order_days"


def order_days(fact: DataFrame) -> DataFrame:
    """order_id, order_month, order_date, revenue, product_revenue,
    freight_revenue, previous_date of the delivered lines.

    The lines of an order are summed map-side first; the window then sees one
    row per order and date. Orders without a purchase time have a null date,
    which comes last.
    """
    days = delivered_lines(fact).groupBy("order_id", "order_month", "order_date").agg(
        F.sum("item_revenue").alias("revenue"),
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue"))
    by_date = Window.partitionBy("order_id").orderBy(F.col("order_date").asc_nulls_last())
    return days.withColumn("previous_date", F.lag("order_date").over(by_date))


def first_in_period(granularity: str | None = None, date_from=None) -> Column:
    """Whether a row is its order's first in its period (without
    ``granularity``: at all) among the rows from ``date_from`` on."""
    previous = F.col("previous_date")
    first = previous.isNull()
    if granularity is not None:
        first = first | ~period_start(previous, granularity).eqNullSafe(
            period_start(F.col("order_date"), granularity))
    if date_from is not None:
        first = first | (previous < F.lit(date_from))
    return first


def summed(days: DataFrame, column: str) -> Column:
    """The sum of a stored sum, in the type that summing the lines has."""
    return F.sum(column).cast(days.schema[column].dataType).alias(column)


def per_period(days: DataFrame, granularity: str, date_from=None) -> DataFrame:
    """period, revenue, orders of the rows of ``days`` (already cut to the range)."""
    return (days.groupBy(period_start(F.col("order_date"), granularity).alias("period"))
            .agg(summed(days, "revenue"),
                 F.count_if(first_in_period(granularity, date_from)).alias("orders")))


def monthly_from_days(days: DataFrame) -> DataFrame:
    """The monthly revenue view."""
    monthly = days.groupBy("order_month").agg(
        summed(days, "revenue"), F.count_if(first_in_period("month")).alias("orders"),
        summed(days, "product_revenue"), summed(days, "freight_revenue"))
    return with_running_growth(monthly, "order_month")
