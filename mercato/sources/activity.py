"""Request, user, statement and login tables derived from the ``events`` table.

The test data has no access log, so each event becomes one request of user
``u<user_id>``; the route and the submitted statement are picked by
``event_id`` from fixed lists. Users are the distinct event users with a role
by ``user_id % 4`` (3 = inactive). Everything is a projection of ``events``
(plus one distinct), so the tables grow with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests as (method, path, query string).
ROUTES = (
    ("GET", "/metrics/revenue", "granularity=month"),
    ("GET", "/metrics/categories/top", "limit=10"),
    ("GET", "/metrics/aov", ""),
    ("POST", "/query", ""),
    ("POST", "/nl-query", ""),
    ("GET", "/admin/audit-log", "limit=100"),
    ("GET", "/admin/users", ""),
    ("GET", "/metrics/delivery-sla", ""),
    ("GET", "/health", ""),
)

# Role by user_id % 4; the last one is an inactive account.
ROLE_BY_MOD = ("viewer", "analyst", "admin", "analyst")
INACTIVE_MOD = 3

# Submitted statements ({u} is replaced by the user id).
STATEMENTS = (
    "DELETE FROM analytics.fct_order_items",
    "UPDATE analytics.dim_product SET category = 'x'",
    "DROP TABLE analytics.fct_order_items",
    "TRUNCATE analytics.fct_order_items",
    "SELECT 1; DROP TABLE analytics.dim_product",
    "SELECT * FROM raw.orders",
    "SELECT * FROM app.users",
    "SELECT * FROM pg_catalog.pg_roles",
    "SELECT * FROM vw_category_performance -- exfiltrate",
    "INSERT INTO analytics.dim_seller VALUES ('x')",
    "SELECT category, revenue FROM vw_category_performance ORDER BY revenue DESC LIMIT 5",
    "SELECT order_month, revenue FROM vw_monthly_revenue "
    "WHERE EXTRACT(year FROM order_month) = 1997 ORDER BY order_month LIMIT 12",
    "SELECT order_id FROM fct_order_items",
    "SELECT 1",
    "WITH t AS (SELECT * FROM analytics.dim_date) SELECT * FROM t;;",
    "SELECT 1; ;",
    "   \n\t ",
    ";",
    "SELECT * FROM vw_delivery_sla a, raw.orders b",
    "SELECT 'set' AS x",
    "SELECT * FROM analytics.a.b",
    "select * from Raw.Orders",
    "SELECT seller_id FROM vw_seller_scorecard WHERE revenue_rank <= {u}",
    "SELECT d.year, count(*) AS n FROM dim_date d JOIN fct_order_items f "
    "ON f.order_date = d.date_key GROUP BY d.year",
    "SELECT SUBSTRING(category FROM 1 FOR 3) AS c FROM analytics.dim_product LIMIT {u}",
    "SELECT reflect('java.lang.System', 'getenv') FROM dim_date",
)

# Statements of which some fail when they are analysed ({e} is the event's type).
FALLIBLE = (
    "SELECT {e} FROM analytics.dim_product",
    "SELECT category, revenue FROM vw_category_performance WHERE category <> '{e}'",
    "SELECT {e}_rank(category) FROM dim_product",
    "SELECT category, sum(revenue) AS revenue FROM vw_category_performance",
    "SELECT order_month FROM vw_monthly_revenue WHERE order_month >",
    "SELECT * FROM raw.{e}",
    "SELECT count(*) AS n, '{e}' AS kind FROM dim_date;",
    "SELECT date_key FROM dim_date WHERE is_weekend + 1 = 2",
    "SELECT a.state FROM dim_customer a JOIN dim_seller b ON a.state = b.state WHERE state = '{e}'",
    "SELECT state FROM vw_delivery_sla, raw.{e}",
    "SELECT seller_id, revenue FROM vw_seller_scorecard ORDER BY {e}",
)

# How generated statements may arrive (fenced or bare).
FENCES = (("```sql\n", "\n```"), ("```\n", "\n```"), ("", ""), ("  ", " ;\n"))


def _pick(options, index_col):
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (index_col % len(options)).cast("int") + 1)


def _user(col: str = "user_id"):
    return F.concat(F.lit("u"), F.col(col).cast("string"))


def requests_from_events(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.cast("long").alias("id"), _user().alias("username"),
        _pick([r[0] for r in ROUTES], e).alias("method"),
        _pick([r[1] for r in ROUTES], e).alias("path"),
        _pick([r[2] for r in ROUTES], e).alias("query_string"),
        F.col("ts").alias("created_at"))


def users_from_events(events: DataFrame) -> DataFrame:
    ids = events.select("user_id").distinct()
    return ids.select(
        _user().alias("username"),
        _pick(ROLE_BY_MOD, F.col("user_id")).alias("role"),
        (F.col("user_id") % 4 != INACTIVE_MOD).alias("is_active"))


def statement_text(index_col, user_col):
    return F.replace(_pick(STATEMENTS, index_col), F.lit("{u}"), user_col.cast("string"))


def query_log_from_events(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.cast("long").alias("id"), _user().alias("username"),
        statement_text(e, F.col("user_id")).alias("sql"),
        F.col("ts").alias("created_at"))


def failing_log_from_events(events: DataFrame) -> DataFrame:
    """Statements over the event's type, as valid and as wrong as users write them."""
    e = F.col("event_id")
    text = F.replace(_pick(FALLIBLE, e), F.lit("{e}"), F.col("event_type"))
    return events.select(e.cast("long").alias("id"), _user().alias("username"), text.alias("sql"),
                         F.col("ts").alias("created_at"))


def generated_log_from_events(events: DataFrame) -> DataFrame:
    """Questions with generated SQL text, fenced in the ways generators answer."""
    e = F.col("event_id")
    body = statement_text(e, F.col("user_id"))
    fence = (e / len(STATEMENTS)).cast("long")
    return events.select(
        e.cast("long").alias("id"), _user().alias("username"),
        F.concat(F.lit("question "), e.cast("string")).alias("question"),
        F.concat(_pick([f[0] for f in FENCES], fence), body,
                 _pick([f[1] for f in FENCES], fence)).alias("generated"),
        F.col("ts").alias("created_at"))


def login_attempts_from_events(events: DataFrame) -> DataFrame:
    """Sign-up events as login attempts; every fifth one has a wrong password."""
    return events.where(F.col("event_type") == "signup").select(
        F.col("event_id").cast("long").alias("id"), _user().alias("username"),
        (F.col("event_id") % 5 != 0).alias("authenticated"),
        F.col("ts").alias("created_at"))
