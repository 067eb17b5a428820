"""Fixed schemas of the landing, analytics and audit tables.

The landing schemas mirror the CSV headers column for column (the loader never
infers types); money is decimal(12,2) and all order timestamps are
timestamp_ntz, as in the source system.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()
NTZ, TS, DATE = T.TimestampNTZType(), T.TimestampType(), T.DateType()
L, B = T.LongType(), T.BooleanType()
MONEY = T.DecimalType(12, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "customers": _struct(
        ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
        ("customer_city", S), ("customer_state", S)),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", S), ("geolocation_lat", D), ("geolocation_lng", D),
        ("geolocation_city", S), ("geolocation_state", S)),
    "order_items": _struct(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", NTZ), ("price", MONEY), ("freight_value", MONEY)),
    "order_payments": _struct(
        ("order_id", S), ("payment_sequential", I), ("payment_type", S),
        ("payment_installments", I), ("payment_value", MONEY)),
    "order_reviews": _struct(
        ("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
        ("review_comment_message", S), ("review_creation_date", NTZ),
        ("review_answer_timestamp", NTZ)),
    "orders": _struct(
        ("order_id", S), ("customer_id", S), ("order_status", S),
        ("order_purchase_timestamp", NTZ), ("order_approved_at", NTZ),
        ("order_delivered_carrier_date", NTZ), ("order_delivered_customer_date", NTZ),
        ("order_estimated_delivery_date", NTZ)),
    # "lenght" is the source's own spelling and is kept.
    "products": _struct(
        ("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
        ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", I),
        ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I)),
    "sellers": _struct(
        ("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S)),
    "product_category_name_translation": _struct(
        ("product_category_name", S), ("product_category_name_english", S)),
}

# Landing file of each raw table (fixed values: the source export's file names).
RAW_FILES: dict[str, str] = {
    "customers": "olist_customers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "product_category_name_translation": "product_category_name_translation.csv",
}

# Tables whose CSV carries quoted text with embedded newlines (not splittable).
MULTILINE_TABLES = frozenset({"order_reviews"})

DIMENSIONS = ("dim_product", "dim_customer", "dim_seller", "dim_date")
FACT = "fct_order_items"
VIEWS = ("vw_monthly_revenue", "vw_category_performance", "vw_seller_scorecard",
         "vw_delivery_sla")
ANALYTICS_OBJECTS = DIMENSIONS + (FACT,) + VIEWS

# Primary keys asserted when the dimensions are built.
PRIMARY_KEYS = {
    "dim_product": "product_id",
    "dim_customer": "customer_id",
    "dim_seller": "seller_id",
    "dim_date": "date_key",
}

AUDIT_SCHEMA = _struct(
    ("id", L), ("username", S), ("role", S), ("action", S), ("detail", S),
    ("status", S), ("created_at", NTZ))

REQUESTS_SCHEMA = _struct(
    ("id", L), ("username", S), ("method", S), ("path", S), ("query_string", S),
    ("created_at", NTZ))
