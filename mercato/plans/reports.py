"""KPI reports over the warehouse: trend, top lists, AOV, SLA, repeat customers.

Every report is a lazy DataFrame (or a dict of them for composite reports).
Arguments are checked before any plan is built. Top-k lists use an ordered
limit (each partition keeps k rows) instead of sorting everything.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.dates import check_granularity, period_start
from mercato.functions.numeric import money_ratio, pct
from mercato.operators.ranking import top_k_ranked
from mercato.plans.model import Warehouse
from mercato.plans.rollup import first_in_period, per_period, summed
from mercato.plans.views import (delivered_lines, is_delivered, seller_aggregate, sla_final,
                                 sla_measures, with_running_growth)

# Fixed defaults and bounds of the report arguments.
DEFAULT_TOP_CATEGORIES = 10
DEFAULT_TOP_SELLERS = 20
MAX_TOP = 100


def _as_date(value) -> dt.date | None:
    if value is None or isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.datetime):
        return value.date()
    return dt.date.fromisoformat(str(value))


def _check_limit(limit: int) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= MAX_TOP:
        raise ValueError(f"limit must be an integer in 1..{MAX_TOP}, got {limit!r}")
    return limit


def revenue_trend(wh: Warehouse, granularity: str = "month", date_from=None,
                  date_to=None) -> DataFrame:
    """Revenue and orders per day/week/month with running total and growth.

    Bounds are inclusive dates. Beside the exact timestamp predicate the same
    bound is stated on ``order_month`` (the partition column), so a fact or an
    order-level rollup stored by month is pruned to the months in range.
    """
    check_granularity(granularity)
    date_from, date_to = _as_date(date_from), _as_date(date_to)
    days = wh.order_days
    if days is None:
        per = _trend_from_lines(wh.fact, granularity, date_from, date_to)
    else:
        if date_from is not None:
            days = days.where((F.col("order_date") >= F.lit(date_from))
                              & (F.col("order_month") >= F.lit(date_from.replace(day=1))))
        if date_to is not None:
            days = days.where((F.col("order_date") <= F.lit(date_to))
                              & (F.col("order_month") <= F.lit(date_to.replace(day=1))))
        per = per_period(days, granularity, date_from)
    return (with_running_growth(per, "period")
            .orderBy(F.col("period").asc_nulls_last())
            .select("period", "revenue", "orders", "running_total_revenue", "mom_growth_pct"))


def _trend_from_lines(fact: DataFrame, granularity: str, date_from, date_to) -> DataFrame:
    """period, revenue, orders from the lines of the fact."""
    ts = F.col("order_purchase_timestamp")
    cond = is_delivered()
    if date_from is not None:
        cond = cond & (ts >= F.lit(date_from).cast("timestamp_ntz"))
        cond = cond & (F.col("order_month") >= F.lit(date_from.replace(day=1)))
    if date_to is not None:
        cond = cond & (ts < F.lit(date_to + dt.timedelta(days=1)).cast("timestamp_ntz"))
        cond = cond & (F.col("order_month") <= F.lit(date_to.replace(day=1)))
    return (fact.where(cond)
            .groupBy(period_start(ts, granularity).alias("period"))
            .agg(F.sum("item_revenue").alias("revenue"),
                 F.count_distinct("order_id").alias("orders")))


def top_categories(wh: Warehouse, limit: int = DEFAULT_TOP_CATEGORIES) -> DataFrame:
    limit = _check_limit(limit)
    view = wh["vw_category_performance"]
    return (view.where(F.col("revenue_rank") <= limit)
            .orderBy("revenue_rank", "category").limit(limit)
            .select("revenue_rank", "category", "revenue", "items_sold", "orders",
                    "avg_review_score", "revenue_share_pct"))


def seller_scorecard(wh: Warehouse, limit: int = DEFAULT_TOP_SELLERS) -> DataFrame:
    """Top sellers by revenue; the rank is exact (equal to the full view's)."""
    limit = _check_limit(limit)
    if wh.stored_views:
        top = (wh["vw_seller_scorecard"].where(F.col("revenue_rank") <= limit)
               .orderBy("revenue_rank", "seller_id").limit(limit))
    else:
        sellers = seller_aggregate(wh.fact, wh["dim_seller"])
        top = top_k_ranked(sellers, "revenue", limit, "revenue_rank", "seller_id")
    return top.orderBy("revenue_rank", "seller_id").select(
        "revenue_rank", "seller_id", "seller_state", "revenue", "items_sold", "orders",
        "avg_review_score", "avg_delivery_days")


def aov_overall(wh: Warehouse) -> DataFrame:
    """Average order value over all delivered orders (always one row)."""
    days = wh.order_days
    if days is None:
        agg = delivered_lines(wh.fact).agg(F.sum("item_revenue").alias("revenue"),
                                           F.count_distinct("order_id").alias("orders"))
    else:
        agg = days.agg(summed(days, "revenue"), F.count_if(first_in_period()).alias("orders"))
    return agg.select("revenue", "orders",
                      money_ratio(F.col("revenue"), F.col("orders")).alias("aov"))


def aov_by_category(wh: Warehouse) -> DataFrame:
    """AOV per category; an order counts once in every category it touches."""
    if wh.stored_views:  # the stored view has both measures
        agg = wh["vw_category_performance"]
    else:
        lines = delivered_lines(wh.fact).select("product_id", "order_id", "item_revenue")
        agg = (lines.join(wh["dim_product"].select("product_id", "category"), "product_id")
               .groupBy("category")
               .agg(F.sum("item_revenue").alias("revenue"),
                    F.count_distinct("order_id").alias("orders")))
    return (agg.orderBy(F.col("revenue").desc_nulls_first(), "category")
            .select("category", money_ratio(F.col("revenue"), F.col("orders")).alias("aov"),
                    "orders", "revenue"))


def aov_by_payment_type(wh: Warehouse) -> DataFrame:
    """AOV per primary payment type (payment_sequential = 1).

    Revenue is first reduced to one row per order; the join with the primary
    payment then runs on the aggregate's own order_id partitioning. The stored
    rollup is joined as it is: an order counts by its first row.
    """
    days = wh.order_days
    if days is None:
        order_rev = (delivered_lines(wh.fact).groupBy("order_id")
                     .agg(F.sum("item_revenue").alias("order_revenue"))
                     .withColumn("counted", F.lit(True)))
    else:
        order_rev = days.select("order_id", F.col("revenue").alias("order_revenue"),
                                first_in_period().alias("counted"))
    primary = (wh.payments.where(F.col("payment_sequential") == 1)
               .select("order_id", "payment_type"))
    agg = (order_rev.join(primary, "order_id").groupBy("payment_type")
           .agg(F.sum("order_revenue").alias("revenue"),
                F.count_if("counted").alias("orders")))
    return (agg.orderBy(F.col("revenue").desc_nulls_first(), "payment_type")
            .select("payment_type", money_ratio(F.col("revenue"), F.col("orders")).alias("aov"),
                    "orders", "revenue"))


def aov(wh: Warehouse) -> dict[str, DataFrame]:
    return {"overall": aov_overall(wh), "by_category": aov_by_category(wh),
            "by_payment_type": aov_by_payment_type(wh)}


def delivery_sla_overall(wh: Warehouse) -> DataFrame:
    """SLA measures over every line of the fact (no status filter, no join)."""
    m = wh.fact.agg(*sla_measures(wh.fact))
    return m.select(*sla_final(F.col("_delivered"), F.col("_days_sum"), F.col("_days_n"),
                               F.col("_on_time"), F.col("_on_time_known")))


def delivery_sla(wh: Warehouse) -> dict[str, DataFrame]:
    by_state = wh["vw_delivery_sla"].orderBy(F.col("delivered_items").desc_nulls_first(),
                                             "customer_state")
    return {"overall": delivery_sla_overall(wh), "by_state": by_state}


def repeat_customers(wh: Warehouse) -> DataFrame:
    """Share of people (customer_unique_id) with more than one delivered order."""
    # One row per customer and order before anything is joined or moved by person.
    orders = (delivered_lines(wh.fact).groupBy("customer_id", "order_id")
              .agg(F.sum("item_revenue").alias("order_revenue")))
    people = (orders.join(wh["dim_customer"].select("customer_id", "customer_unique_id"),
                          "customer_id")
              .groupBy("customer_unique_id")
              .agg(F.count_distinct("order_id").alias("orders"),
                   F.sum("order_revenue").alias("revenue")))
    repeat = F.col("orders") > 1
    total_n, repeat_n = F.count(F.lit(1)), F.count_if(repeat)
    # sum(...) FILTER: no otherwise, so no matching person gives NULL, not 0.
    total_rev, repeat_rev = F.sum("revenue"), F.sum(F.when(repeat, F.col("revenue")))
    return people.agg(
        total_n.alias("total_customers"),
        repeat_n.alias("repeat_customers"),
        pct(repeat_n, total_n).alias("repeat_rate_pct"),
        total_rev.alias("total_revenue"),
        repeat_rev.alias("repeat_revenue"),
        pct(repeat_rev, total_rev).alias("repeat_revenue_share_pct"))


def _count_of(df: DataFrame, label: str, label_col: str, count_col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(count_col)).select(
        F.lit(label).alias(label_col), count_col)


def object_counts(wh: Warehouse) -> DataFrame:
    """Row count of the fact and the four dimensions (UNION ALL of counts)."""
    names = ("fct_order_items", "dim_product", "dim_customer", "dim_seller", "dim_date")
    return reduce(DataFrame.unionByName,
                  [_count_of(wh[n], n, "object", "count") for n in names])


def raw_row_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """Rows per landing table plus the grand total (table_name 'total').

    Each table is scanned once; the total is a rollup over the nine one-row
    counts, not a second scan.
    """
    counts = reduce(DataFrame.unionByName,
                    [_count_of(df, name, "table_name", "row_count")
                     for name, df in raw.items()])
    return (counts.rollup("table_name").agg(F.sum("row_count").alias("row_count"))
            .select(F.coalesce("table_name", F.lit("total")).alias("table_name"),
                    F.col("row_count").cast("long").alias("row_count")))


# ---- sample reports (fixed row counts are the feature) ----------------------

def sample_monthly(wh: Warehouse, n: int = 12) -> DataFrame:
    return (wh["vw_monthly_revenue"].orderBy(F.col("order_month").asc_nulls_last()).limit(n)
            .select("order_month", "revenue", "running_total_revenue", "mom_growth_pct"))


def sample_categories(wh: Warehouse, n: int = 10) -> DataFrame:
    return top_categories(wh, n).select("revenue_rank", "category", "revenue",
                                        "revenue_share_pct", "avg_review_score")


def sample_sellers(wh: Warehouse, n: int = 10) -> DataFrame:
    return seller_scorecard(wh, n).select("revenue_rank", "seller_id", "seller_state",
                                          "revenue", "avg_review_score", "orders")


def sample_states(wh: Warehouse, n: int = 10) -> DataFrame:
    return (wh["vw_delivery_sla"]
            .orderBy(F.col("delivered_items").desc_nulls_first(), "customer_state").limit(n)
            .select("customer_state", "delivered_items", "avg_delivery_days", "on_time_pct"))
