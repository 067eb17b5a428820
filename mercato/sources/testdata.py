"""Adapter from the TPC-H-like test tables to the nine raw landing tables.

Every raw table is a projection (plus at most a lookup join) of one test table,
so the adapter is a set of narrow, lazily evaluated DataFrames: Catalyst prunes
the columns each report needs and pushes filters into the Parquet scans.
The mapping uses plain arithmetic only, so an SQL oracle can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.schemas import RAW_SCHEMAS

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _key(c: str):
    return F.col(c).cast("string")


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Cast and order the columns exactly as the landing schema says."""
    schema = RAW_SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _interval(days, hours=None):
    hours = F.lit(0) if hours is None else hours
    return F.make_dt_interval(days.cast("int"), hours.cast("int"))


def raw_orders(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    purchase = F.col("o_orderdate")
    delivered_flag = (F.col("o_orderstatus") == "F") | (k % 13 == 0)
    return _conform(o.select(
        _key("o_orderkey").alias("order_id"),
        _key("o_orderkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
         .when(F.col("o_orderstatus") == "O", "shipped")
         .when(F.col("o_orderstatus") == "P", "canceled").alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        (purchase + _interval(F.lit(0), F.lit(1))).alias("order_approved_at"),
        (purchase + _interval(F.lit(2))).alias("order_delivered_carrier_date"),
        F.when(delivered_flag, purchase + _interval(5 + k % 40, k % 24))
         .alias("order_delivered_customer_date"),
        (purchase + _interval(F.lit(30))).alias("order_estimated_delivery_date"),
    ), "orders")


def raw_order_items(li: DataFrame) -> DataFrame:
    freight = F.round((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(28,10)"), 2)
    return _conform(li.select(
        _key("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        _key("l_partkey").alias("product_id"),
        _key("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        freight.alias("freight_value"),
    ), "order_items")


def raw_order_reviews(o: DataFrame) -> DataFrame:
    """First review where key % 7 <> 0, a second one where key % 11 = 0."""
    k = F.col("o_orderkey")
    created = F.col("o_orderdate") + _interval(10 + k % 5)

    def review(seq: int, score, cond):
        return o.where(cond).select(
            F.concat(_key("o_orderkey"), F.lit(f"-{seq}")).alias("review_id"),
            _key("o_orderkey").alias("order_id"),
            score.alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.lit(None).cast("string").alias("review_comment_message"),
            created.alias("review_creation_date"),
            (created + _interval(F.lit(1))).alias("review_answer_timestamp"))

    first = review(1, 1 + k % 5, k % 7 != 0)
    second = review(2, 1 + (k + 2) % 5, k % 11 == 0)
    return _conform(first.unionByName(second), "order_reviews")


def raw_order_payments(o: DataFrame) -> DataFrame:
    """Primary payment where key % 17 <> 0; a voucher as second where key % 9 = 0."""
    k = F.col("o_orderkey")
    primary = o.where(k % 17 != 0).select(
        _key("o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"),
        F.col("o_orderpriority").alias("payment_type"), F.lit(1).alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"))
    voucher = o.where(k % 9 == 0).select(
        _key("o_orderkey").alias("order_id"), F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"), F.lit(1).alias("payment_installments"),
        F.round(F.col("o_totalprice").cast("decimal(12,2)") / 10, 2).alias("payment_value"))
    return _conform(primary.unionByName(voucher), "order_payments")


def raw_customers(o: DataFrame, c: DataFrame, n: DataFrame) -> DataFrame:
    """One customer row per order; the person is the TPC-H customer."""
    cust = c.select("c_custkey", "c_nationkey")
    nat = n.select("n_nationkey", "n_name")
    joined = (o.select("o_orderkey", "o_custkey")
              .join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
              .join(nat, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    return _conform(joined.select(
        _key("o_orderkey").alias("customer_id"),
        _key("o_custkey").alias("customer_unique_id"),
        F.lpad(_key("c_nationkey"), 5, "0").alias("customer_zip_code_prefix"),
        F.col("n_name").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    ), "customers")


def raw_sellers(s: DataFrame, n: DataFrame) -> DataFrame:
    joined = (s.select("s_suppkey", "s_nationkey")
              .join(n.select("n_nationkey", "n_name"),
                    F.col("s_nationkey") == F.col("n_nationkey"), "left"))
    return _conform(joined.select(
        _key("s_suppkey").alias("seller_id"),
        F.lpad(_key("s_nationkey"), 5, "0").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    ), "sellers")


def raw_products(p: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return _conform(p.select(
        _key("p_partkey").alias("product_id"),
        F.when(k % 50 != 0, F.col("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        (F.length("p_name") * 10).alias("product_description_lenght"),
        (k % 5).alias("product_photos_qty"),
        (size * 10).alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"),
    ), "products")


def raw_category_translation(p: DataFrame) -> DataFrame:
    """Every category except PROMO gets an English (lower-case) name."""
    types = p.select("p_type").where(F.col("p_type") != "PROMO").distinct()
    return _conform(types.select(
        F.col("p_type").alias("product_category_name"),
        F.lower("p_type").alias("product_category_name_english"),
    ), "product_category_name_translation")


def raw_geolocation(n: DataFrame) -> DataFrame:
    return _conform(n.select(
        F.lpad(_key("n_nationkey"), 5, "0").alias("geolocation_zip_code_prefix"),
        F.col("n_nationkey").cast("double").alias("geolocation_lat"),
        (-F.col("n_nationkey")).cast("double").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    ), "geolocation")


def raw_from_testdata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine raw tables as lazy DataFrames over the test Parquet files."""
    t = {name: read_test_table(spark, sf_dir, name)
         for name in ("orders", "lineitem", "customer", "supplier", "part", "nation")}
    return {
        "customers": raw_customers(t["orders"], t["customer"], t["nation"]),
        "geolocation": raw_geolocation(t["nation"]),
        "order_items": raw_order_items(t["lineitem"]),
        "order_payments": raw_order_payments(t["orders"]),
        "order_reviews": raw_order_reviews(t["orders"]),
        "orders": raw_orders(t["orders"]),
        "products": raw_products(t["part"]),
        "sellers": raw_sellers(t["supplier"], t["nation"]),
        "product_category_name_translation": raw_category_translation(t["part"]),
    }
