"""The four pre-aggregated views, as lazy DataFrames over the star schema.

Views carry no ORDER BY (sorting is the report's job), so reading a view costs
no range shuffle, and defining one runs no job. The only window without
PARTITION BY over the views' own rows is the running total over months (a
calendar); ranks are distributed (``global_rank``) and the revenue share uses
a one-row total. A build writes the views as tables, so reading them there
never touches the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.numeric import exact_avg, pct, round2, safe_div
from mercato.operators.ranking import global_rank


def is_delivered():
    return F.col("order_status") == "delivered"


def delivered_lines(fact: DataFrame) -> DataFrame:
    return fact.where(is_delivered())


def with_running_growth(per: DataFrame, key: str) -> DataFrame:
    """Running total and growth vs. the previous existing row, ordered by ``key``.

    NULL keys sort last, as in the reference database.
    """
    w = Window.orderBy(F.col(key).asc_nulls_last())
    with_prev = per.select(
        "*",
        F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0))
         .alias("running_total_revenue"),
        F.lag("revenue").over(w).alias("_prev"))
    prev = F.col("_prev")
    return (with_prev.withColumn("mom_growth_pct", pct(F.col("revenue") - prev, prev))
            .drop("_prev"))


def vw_monthly_revenue(fact: DataFrame) -> DataFrame:
    monthly = (delivered_lines(fact).groupBy("order_month").agg(
        F.sum("item_revenue").alias("revenue"),
        F.count_distinct("order_id").alias("orders"),
        F.sum("price").alias("product_revenue"),
        F.sum("freight_value").alias("freight_revenue")))
    return with_running_growth(monthly, "order_month")


def category_aggregate(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    lines = delivered_lines(fact).select("product_id", "order_id", "item_revenue",
                                         "avg_review_score")
    return (lines.join(dim_product.select("product_id", "category"), "product_id")
            .groupBy("category").agg(
                F.sum("item_revenue").alias("revenue"),
                F.count(F.lit(1)).alias("items_sold"),
                F.count_distinct("order_id").alias("orders"),
                exact_avg(F.col("avg_review_score")).alias("avg_review_score")))


def category_view(categories: DataFrame) -> DataFrame:
    """The category view from the per-category measures."""
    total = categories.agg(F.sum("revenue").alias("_total"))  # one row
    return (global_rank(categories, "revenue", "revenue_rank").crossJoin(F.broadcast(total))
            .select("category", "revenue", "items_sold", "orders",
                    round2(F.col("avg_review_score")).alias("avg_review_score"), "revenue_rank",
                    pct(F.col("revenue"), F.col("_total")).alias("revenue_share_pct")))


def vw_category_performance(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    return category_view(category_aggregate(fact, dim_product))


def seller_aggregate(fact: DataFrame, dim_seller: DataFrame) -> DataFrame:
    """Per-seller measures, aggregated before the dimension join.

    seller_id is the key of dim_seller (asserted at build), so grouping by
    (seller_id, state) equals grouping by seller_id and attaching the state
    afterwards; the join then sees one row per seller instead of every line.
    """
    per_seller = delivered_lines(fact).groupBy("seller_id").agg(
        F.sum("item_revenue").alias("revenue"),
        F.count(F.lit(1)).alias("items_sold"),
        F.count_distinct("order_id").alias("orders"),
        exact_avg(F.col("avg_review_score")).alias("avg_review_score"),
        exact_avg(F.col("delivery_days")).alias("avg_delivery_days"))
    sellers = dim_seller.select("seller_id", F.col("state").alias("seller_state"))
    return per_seller.join(sellers, "seller_id").select(
        "seller_id", "seller_state", "revenue", "items_sold", "orders",
        round2(F.col("avg_review_score")).alias("avg_review_score"),
        round2(F.col("avg_delivery_days")).alias("avg_delivery_days"))


def seller_view(sellers: DataFrame) -> DataFrame:
    """The seller view from the per-seller measures."""
    return global_rank(sellers, "revenue", "revenue_rank").select(
        "seller_id", "seller_state", "revenue", "items_sold", "orders",
        "avg_review_score", "avg_delivery_days", "revenue_rank")


def vw_seller_scorecard(fact: DataFrame, dim_seller: DataFrame) -> DataFrame:
    """Sellers with the distributed global revenue rank."""
    return seller_view(seller_aggregate(fact, dim_seller))


def sla_measures(df: DataFrame) -> list:
    """Partial SLA measures (sums and counts) that can be merged at any level."""
    return [
        F.count_if(F.col("order_delivered_customer_date").isNotNull()).alias("_delivered"),
        F.sum("delivery_days").alias("_days_sum"),
        F.count("delivery_days").alias("_days_n"),
        F.count_if(F.col("on_time") == F.lit(True)).alias("_on_time"),
        F.count_if(F.col("on_time").isNotNull()).alias("_on_time_known"),
    ]


def sla_final(delivered, days_sum, days_n, on_time, on_time_known) -> list:
    return [
        delivered.alias("delivered_items"),
        round2(safe_div(days_sum, days_n.cast("decimal(20,0)"))).alias("avg_delivery_days"),
        pct(on_time, on_time_known).alias("on_time_pct"),
    ]


def vw_delivery_sla(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """On-time share and delivery days by customer state (all statuses).

    The fact is first reduced to one row per customer_id (the key of
    dim_customer), so the join shuffles one row per order, not per line.
    """
    per_customer = fact.groupBy("customer_id").agg(*sla_measures(fact))
    states = dim_customer.select("customer_id", "state")
    by_state = (per_customer.join(states, "customer_id").groupBy("state").agg(
        F.sum("_delivered").alias("_delivered"), F.sum("_days_sum").alias("_days_sum"),
        F.sum("_days_n").alias("_days_n"), F.sum("_on_time").alias("_on_time"),
        F.sum("_on_time_known").alias("_on_time_known")))
    return by_state.select(
        F.col("state").alias("customer_state"),
        *sla_final(F.col("_delivered"), F.col("_days_sum"), F.col("_days_n"),
                   F.col("_on_time"), F.col("_on_time_known")))


def view_tables(tables) -> dict:
    """View factories: each view is planned when first read.

    ``tables`` maps object names to DataFrames (or resolves them lazily).
    """
    return {
        "vw_monthly_revenue": lambda: vw_monthly_revenue(tables["fct_order_items"]),
        "vw_category_performance": lambda: vw_category_performance(
            tables["fct_order_items"], tables["dim_product"]),
        "vw_seller_scorecard": lambda: vw_seller_scorecard(
            tables["fct_order_items"], tables["dim_seller"]),
        "vw_delivery_sla": lambda: vw_delivery_sla(
            tables["fct_order_items"], tables["dim_customer"]),
    }
