"""Star schema: four dimensions and the order-line fact (lazy DataFrames).

The fact joins three inputs that all share ``order_id``: orders and the
per-order review score form one row per order, and the order lines meet that
order-level table in one join. Payments are per order and stay out of the
fact (they would double count).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.dates import (MICROS_PER_DAY, iso_dow, microseconds_between,
                                     weekday_name_padded)
from mercato.functions.numeric import from_hundredths, hundredths_half_up


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    """One row per product with the English category (Portuguese, then 'unknown')."""
    t = translation.select("product_category_name", "product_category_name_english")
    p = products.select("product_id", "product_category_name", "product_weight_g",
                        "product_length_cm", "product_height_cm", "product_width_cm")
    return p.join(t, "product_category_name", "left").select(
        "product_id",
        F.col("product_category_name").alias("category_pt"),
        F.coalesce("product_category_name_english", "product_category_name",
                   F.lit("unknown")).alias("category"),
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


def dim_customer(customers: DataFrame) -> DataFrame:
    """Per-order customer id; customer_unique_id is the person."""
    return customers.select(
        "customer_id", "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("zip_code_prefix"),
        F.col("customer_city").alias("city"),
        F.col("customer_state").alias("state"))


def dim_seller(sellers: DataFrame) -> DataFrame:
    return sellers.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("zip_code_prefix"),
        F.col("seller_city").alias("city"),
        F.col("seller_state").alias("state"))


def dim_date(orders: DataFrame) -> DataFrame:
    """Continuous daily calendar over the span of purchase dates.

    The bounds are one global aggregate (partial min/max per partition); the
    days are generated by ``sequence`` + ``explode`` - a generator, no join.
    Its size follows the date span, not the data volume.
    """
    bounds = (orders.where(F.col("order_purchase_timestamp").isNotNull())
              .agg(F.min(F.to_date("order_purchase_timestamp")).alias("d0"),
                   F.max(F.to_date("order_purchase_timestamp")).alias("d1")))
    days = bounds.where(F.col("d0").isNotNull()).select(
        F.explode(F.sequence("d0", "d1", F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    d = F.col("date_key")
    return days.select(
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.dayofmonth(d).alias("day"),
        iso_dow(d).alias("iso_dow"),
        weekday_name_padded(d).alias("weekday_name"),
        (iso_dow(d) >= 6).alias("is_weekend"))


def order_review_scores(reviews: DataFrame) -> DataFrame:
    """Average review score per order as decimal(4,2) (exact, half away from zero)."""
    per_order = (reviews.where(F.col("review_score").isNotNull())
                 .groupBy("order_id")
                 .agg(F.sum("review_score").alias("_s"), F.count("review_score").alias("_n")))
    return per_order.select(
        "order_id",
        from_hundredths(hundredths_half_up(F.col("_s"), F.col("_n")), 4).alias("avg_review_score"))


def order_level(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per order: the order's columns and its average review score.

    Both inputs are keyed by order_id, so this join cannot fan out.
    """
    o = orders.select("order_id", "customer_id", "order_status",
                      "order_purchase_timestamp", "order_approved_at",
                      "order_delivered_customer_date", "order_estimated_delivery_date")
    return o.join(order_review_scores(reviews), "order_id", "left")


def joined_lines(order_items: DataFrame, order_info: DataFrame) -> DataFrame:
    """Order lines with their order's row and month, without derived measures.

    When ``order_info`` is read from storage (as the build does), this is one
    join of two scans, so AQE splits the partition of an order that holds a
    large share of all lines.
    """
    oi = order_items.select("order_id", "order_item_id", "product_id", "seller_id",
                            "price", "freight_value")
    return oi.join(order_info, "order_id", "inner").withColumn(
        "order_month", F.trunc(F.to_date("order_purchase_timestamp"), "month"))


def with_measures(joined: DataFrame) -> DataFrame:
    """The fact: ``joined_lines`` plus the measures derived from each row alone."""
    purchase = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    estimate = F.col("order_estimated_delivery_date")
    return joined.select(
        "order_id", "order_item_id", "product_id", "seller_id", "customer_id",
        "order_status", "order_purchase_timestamp",
        F.to_date(purchase).alias("order_date"), "order_month",
        "order_approved_at", "order_delivered_customer_date",
        "order_estimated_delivery_date", "price", "freight_value",
        (F.col("price") + F.col("freight_value")).alias("item_revenue"),
        F.when(delivered.isNotNull(),
               from_hundredths(hundredths_half_up(microseconds_between(purchase, delivered),
                                                  F.lit(MICROS_PER_DAY)), 8))
         .alias("delivery_days"),
        F.when(delivered.isNull(), F.lit(None).cast("boolean"))
         .when(delivered <= estimate, F.lit(True))
         .otherwise(F.lit(False)).alias("on_time"),
        "avg_review_score")


def fact_from_lines(order_items: DataFrame, order_info: DataFrame) -> DataFrame:
    """Order lines joined with their order's row, plus the derived measures."""
    return with_measures(joined_lines(order_items, order_info))


@dataclass
class Warehouse:
    """The analytics objects plus the one raw table a report reads directly."""

    tables: dict[str, DataFrame]
    raw: dict[str, DataFrame] = field(default_factory=dict)
    # Rebuilds the same warehouse in another session (used for isolation).
    loader: Callable[[SparkSession], "Warehouse"] | None = None
    # The isolated session for ad-hoc SQL, created on first use.
    isolated: SparkSession | None = field(default=None, repr=False, compare=False)
    # Raw tables opened on first use.
    raw_loaders: dict = field(default_factory=dict, repr=False, compare=False)
    # Whether the views are tables of a build (else they are plans over the fact).
    stored_views: bool = False
    # The stored order-level rollup (opened on first use), where a build has one.
    rollup: DataFrame | Callable | None = field(default=None, repr=False, compare=False)

    def __getitem__(self, name: str) -> DataFrame:
        """The object ``name``, planned on first access."""
        obj = self.tables[name]
        if callable(obj):
            obj = obj()
            self.tables[name] = obj
        return obj

    @property
    def fact(self) -> DataFrame:
        return self["fct_order_items"]

    @property
    def order_days(self) -> DataFrame | None:
        """The stored order-level rollup, or None (plans then read the fact)."""
        if callable(self.rollup):
            self.rollup = self.rollup()
        return self.rollup

    @property
    def payments(self) -> DataFrame:
        if "order_payments" not in self.raw:
            self.raw["order_payments"] = self.raw_loaders["order_payments"]()
        return self.raw["order_payments"]

    def in_session(self, session: SparkSession) -> "Warehouse":
        if self.loader is None:
            raise ValueError("this warehouse cannot be re-created in another session")
        return self.loader(session)


def model_tables(raw: dict[str, DataFrame],
                 order_info: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dimensions and fact from the raw tables (nothing is executed).

    ``order_info`` is the order-level table when it was already written (the
    build does so); otherwise it is planned from the raw tables.
    """
    if order_info is None:
        order_info = order_level(raw["orders"], raw["order_reviews"])
    return {
        "dim_product": dim_product(raw["products"], raw["product_category_name_translation"]),
        "dim_customer": dim_customer(raw["customers"]),
        "dim_seller": dim_seller(raw["sellers"]),
        "dim_date": dim_date(raw["orders"]),
        "fct_order_items": fact_from_lines(raw["order_items"], order_info),
    }


def lazy_warehouse(raw: dict[str, DataFrame]) -> Warehouse:
    """Warehouse whose objects are computed from the raw tables on every read."""
    from mercato.plans.views import view_tables

    tables = model_tables(raw)
    tables.update(view_tables(tables))
    return Warehouse(tables=tables, raw={"order_payments": raw["order_payments"]})
