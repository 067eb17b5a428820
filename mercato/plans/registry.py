"""Named queries over a test-data folder, as the verification driver runs them.

Each entry takes (spark, sf_dir), builds the lazy warehouse over the full test
tables and returns one DataFrame whose decimal columns are reported as double
(the form the reports hand to clients).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.numeric import decimals_to_double
from mercato.plans import reports
from mercato.plans.model import Warehouse, lazy_warehouse
from mercato.schemas import RAW_SCHEMAS
from mercato.session import configure
from mercato.sources.testdata import raw_from_testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


_DEFINED: dict[tuple[int, str], Warehouse] = {}


def warehouse_for(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The lazy warehouse over the test tables of ``sf_dir`` in ``spark``.

    Only plans are kept (no data), once per session and folder, so the many
    registered queries do not re-plan the same read-only inputs.
    """
    configure(spark)
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
    if key not in _DEFINED:
        wh = lazy_warehouse(raw_from_testdata(spark, sf_dir))
        wh.loader = lambda session: warehouse_for(session, sf_dir)
        _DEFINED[key] = wh
    return _DEFINED[key]


class _OnDemand:
    """Builds the warehouse on first use (queries over events never need it)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        object.__setattr__(self, "_args", (spark, sf_dir))
        object.__setattr__(self, "_wh", None)

    def _resolve(self) -> Warehouse:
        if self._wh is None:
            object.__setattr__(self, "_wh", warehouse_for(*self._args))
        return self._wh

    def __getattr__(self, name):
        return getattr(self._resolve(), name)

    def __setattr__(self, name, value):
        setattr(self._resolve(), name, value)

    def __getitem__(self, name):
        return self._resolve()[name]


def query(name: str):
    """Register ``fn(wh, spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return decimals_to_double(fn(_OnDemand(spark, sf_dir), spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return wrap


@query("monthly_revenue")
def _monthly(wh, spark, sf_dir):
    return wh["vw_monthly_revenue"]


# ---- star schema -------------------------------------------------------------

for _name in ("dim_product", "dim_customer", "dim_seller", "dim_date", "fct_order_items"):
    query(_name)(lambda wh, spark, sf_dir, _n=_name: wh[_n])


# ---- views -------------------------------------------------------------------

@query("category_performance")
def _category_performance(wh, spark, sf_dir):
    return wh["vw_category_performance"]


@query("seller_scorecard")
def _seller_scorecard(wh, spark, sf_dir):
    return wh["vw_seller_scorecard"]


@query("delivery_sla_by_state")
def _sla_by_state(wh, spark, sf_dir):
    return wh["vw_delivery_sla"]


# ---- reports -----------------------------------------------------------------

@query("delivery_sla_overall")
def _sla_overall(wh, spark, sf_dir):
    return reports.delivery_sla_overall(wh)


@query("revenue_trend_day")
def _trend_day(wh, spark, sf_dir):
    return reports.revenue_trend(wh, "day")


@query("revenue_trend_week")
def _trend_week(wh, spark, sf_dir):
    return reports.revenue_trend(wh, "week")


@query("revenue_trend_month_bounded")
def _trend_month_bounded(wh, spark, sf_dir):
    return reports.revenue_trend(wh, "month", "1996-03-15", "1998-06-30")


@query("revenue_trend_week_bounded")
def _trend_week_bounded(wh, spark, sf_dir):
    return reports.revenue_trend(wh, "week", "1997-01-01", "1997-01-31")


@query("top_categories")
def _top_categories(wh, spark, sf_dir):
    return reports.top_categories(wh, 5)


@query("top_sellers")
def _top_sellers(wh, spark, sf_dir):
    return reports.seller_scorecard(wh, 20)


@query("aov_overall")
def _aov_overall(wh, spark, sf_dir):
    return reports.aov_overall(wh)


@query("aov_by_category")
def _aov_by_category(wh, spark, sf_dir):
    return reports.aov_by_category(wh)


@query("aov_by_payment_type")
def _aov_by_payment(wh, spark, sf_dir):
    return reports.aov_by_payment_type(wh)


@query("repeat_customers")
def _repeat_customers(wh, spark, sf_dir):
    return reports.repeat_customers(wh)


@query("object_counts")
def _object_counts(wh, spark, sf_dir):
    return reports.object_counts(wh)


@query("raw_row_counts")
def _raw_row_counts(wh, spark, sf_dir):
    return reports.raw_row_counts(raw_from_testdata(spark, sf_dir))


@query("sample_monthly")
def _sample_monthly(wh, spark, sf_dir):
    return reports.sample_monthly(wh)


@query("sample_categories")
def _sample_categories(wh, spark, sf_dir):
    return reports.sample_categories(wh)


@query("sample_sellers")
def _sample_sellers(wh, spark, sf_dir):
    return reports.sample_sellers(wh)


@query("sample_states")
def _sample_states(wh, spark, sf_dir):
    return reports.sample_states(wh)


# ---- ad-hoc SQL surface ------------------------------------------------------

def _events(spark, sf_dir):
    from mercato.sources.testdata import read_test_table

    return read_test_table(spark, sf_dir, "events")


ADHOC_SQL = ("SELECT order_id, order_item_id, item_revenue FROM analytics.fct_order_items "
             "ORDER BY item_revenue DESC, order_id, order_item_id;")
GENERATED_SQL = ("```sql\nSELECT category, items_sold, orders FROM analytics.vw_category_performance "
                 "WHERE revenue_rank <= 3;\n```")


@query("screen_queries")
def _screen_queries(wh, spark, sf_dir):
    from mercato.operators.screen import screen_queries
    from mercato.sources.activity import query_log_from_events

    log = query_log_from_events(_events(spark, sf_dir))
    return screen_queries(log).select("id", "username", "sql", "verdict", "reason")


@query("clean_sql_text")
def _clean_sql_text(wh, spark, sf_dir):
    from mercato.functions.text import clean_sql_text
    from mercato.sources.activity import generated_log_from_events

    gen = generated_log_from_events(_events(spark, sf_dir))
    return gen.select("id", "generated", clean_sql_text(F.col("generated")).alias("sql"))


@query("adhoc_capped")
def _adhoc_capped(wh, spark, sf_dir):
    from mercato.plans.adhoc import run_read_only

    return run_read_only(wh, spark, ADHOC_SQL).frame


@query("nl_query_rows")
def _nl_query_rows(wh, spark, sf_dir):
    from mercato.plans.adhoc import generated_query

    return generated_query(wh, spark, "what do the three best categories sell", GENERATED_SQL)["frame"]


# ---- access and audit --------------------------------------------------------

def _access(spark, sf_dir):
    from mercato.operators.access import access_decisions, permissions_frame
    from mercato.sources.activity import requests_from_events, users_from_events

    ev = _events(spark, sf_dir)
    return access_decisions(requests_from_events(ev), users_from_events(ev),
                            permissions_frame(spark))


@query("access_decisions")
def _access_decisions(wh, spark, sf_dir):
    return _access(spark, sf_dir)


@query("query_audit")
def _query_audit(wh, spark, sf_dir):
    from mercato.plans.audit import screen_and_audit
    from mercato.sources.activity import query_log_from_events, users_from_events

    ev = _events(spark, sf_dir)
    return screen_and_audit(query_log_from_events(ev), users_from_events(ev))


@query("nl_query_audit")
def _nl_query_audit(wh, spark, sf_dir):
    from mercato.functions.text import clean_sql_text
    from mercato.operators.screen import screen_queries
    from mercato.plans.audit import nl_query_audit
    from mercato.sources.activity import generated_log_from_events, users_from_events

    ev = _events(spark, sf_dir)
    users = users_from_events(ev).where(F.col("is_active")
                                        & F.col("role").isin("analyst", "admin"))
    gen = generated_log_from_events(ev).join(users.select("username", "role"), "username")
    cleaned = gen.withColumn("sql", clean_sql_text(F.col("generated")))
    return nl_query_audit(screen_queries(cleaned))


@query("login_audit")
def _login_audit(wh, spark, sf_dir):
    from mercato.plans.audit import login_audit
    from mercato.sources.activity import login_attempts_from_events, users_from_events

    ev = _events(spark, sf_dir)
    return login_audit(login_attempts_from_events(ev), users_from_events(ev))


@query("latest_audit")
def _latest_audit(wh, spark, sf_dir):
    from mercato.plans.audit import latest_audit

    return latest_audit(_access(spark, sf_dir), 100)


@query("latest_audit_stored")
def _latest_audit_stored(wh, spark, sf_dir):
    """The decisions appended to a stored log in two batches, its newest rows read back."""
    import uuid

    from mercato.plans.audit import append_audit, newest_audit, without_zone
    from mercato.session import scratch_path

    path = scratch_path(spark, f"mercato/audit-log-{uuid.uuid4().hex}")
    decisions = _access(spark, sf_dir)
    append_audit(decisions.where(F.col("id") % 2 == 0), path)
    append_audit(decisions.where(F.col("id") % 2 == 1), path)
    return without_zone(newest_audit(spark, path, 100))


@query("audit_log_compacted")
def _audit_log_compacted(wh, spark, sf_dir):
    """The decisions appended in four batches, compacted, and read back whole."""
    import uuid

    from mercato.plans import audit_log
    from mercato.plans.audit import without_zone
    from mercato.session import scratch_path

    path = scratch_path(spark, f"mercato/audit-log-{uuid.uuid4().hex}")
    decisions = _access(spark, sf_dir)
    for part in range(4):
        audit_log.append(decisions.where(F.col("id") % 4 == part), path, writer="batches", batch=part)
    audit_log.compact(spark, path, most_files=2)
    audit_log.expire(spark, path, keep=1)
    return without_zone(audit_log.read(spark, path))


@query("audit_log_zones")
def _audit_log_zones(wh, spark, sf_dir):
    """One log whose older half has no zone: all rows, created_at in microseconds (UTC)."""
    import uuid

    from mercato.plans import audit_log
    from mercato.session import scratch_path

    path = scratch_path(spark, f"mercato/audit-log-{uuid.uuid4().hex}")
    decisions = _access(spark, sf_dir)
    old = decisions.where(F.col("id") % 2 == 0).withColumn("day", F.to_date("created_at"))
    old.hint("rebalance", "day").write.partitionBy("day").parquet(path)
    audit_log.adopt(spark, path)
    audit_log.append(audit_log.zoned(decisions.where(F.col("id") % 2 == 1)), path)
    return audit_log.read(spark, path).withColumn("created_at", F.unix_micros("created_at"))


@query("query_audit_with_errors")
def _query_audit_with_errors(wh, spark, sf_dir):
    """Statements some of which pass the screen and fail in the engine."""
    from mercato.plans.statement_audit import audit_statements
    from mercato.sources.activity import failing_log_from_events, users_from_events

    ev = _events(spark, sf_dir)
    return audit_statements(wh, spark, failing_log_from_events(ev), users_from_events(ev))


# ---- landing and build ---------------------------------------------------------

_BUILT: dict[tuple[int, str], Warehouse] = {}


def built_for(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The given tables exported as CSV folders, landed, built and opened.

    Everything is written under the session's shared checkpoint folder, once
    per session and folder.
    """
    import uuid

    from mercato.plans.build import build_from_csv, load_warehouse
    from mercato.session import scratch_path
    from mercato.sources.landing import write_csv_table

    configure(spark)
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
    if key not in _BUILT:
        base = scratch_path(spark, f"mercato/landing-{uuid.uuid4().hex}")
        for table, frame in raw_from_testdata(spark, sf_dir).items():
            write_csv_table(frame, f"{base}/csv", table)
        build_from_csv(spark, f"{base}/csv", f"{base}/warehouse")
        _BUILT[key] = load_warehouse(spark, f"{base}/warehouse")
    return _BUILT[key]


for _table in RAW_SCHEMAS:
    query(f"landed_{_table}")(lambda wh, spark, sf_dir, _t=_table: built_for(spark, sf_dir).raw_loaders[_t]())

for _name in ("fct_order_items", "dim_customer", "dim_date", "dim_product", "dim_seller",
              "vw_monthly_revenue", "vw_category_performance", "vw_seller_scorecard", "vw_delivery_sla"):
    query(f"built_{_name}")(lambda wh, spark, sf_dir, _n=_name: built_for(spark, sf_dir)[_n])


# Reports over the build's order-level rollup.
for _name, _report in {
    "revenue_trend_day": lambda wh: reports.revenue_trend(wh, "day"),
    "revenue_trend_week": lambda wh: reports.revenue_trend(wh, "week"),
    "revenue_trend_month_bounded": lambda wh: reports.revenue_trend(wh, "month", "1996-03-15", "1998-06-30"),
    "aov_overall": reports.aov_overall,
    "aov_by_category": reports.aov_by_category,
    "aov_by_payment_type": reports.aov_by_payment_type,
    "order_days": lambda wh: wh.order_days,
}.items():
    query(f"built_{_name}")(lambda wh, spark, sf_dir, _r=_report: _r(built_for(spark, sf_dir)))


@query("built_top_sellers")
def _built_top_sellers(wh, spark, sf_dir):
    return reports.seller_scorecard(built_for(spark, sf_dir), 20)


@query("key_violations")
def _key_violations(wh, spark, sf_dir):
    """Per dimension of the build: keys that are NULL or repeat."""
    from functools import reduce

    from mercato.schemas import PRIMARY_KEYS

    built = built_for(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        built[dim].groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        .where("k is null or n > 1").agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit(dim).alias("dimension"), "violations") for dim, key in PRIMARY_KEYS.items()])


# ---- result shaping for charts -----------------------------------------------

@query("coerce_numeric")
def _coerce_numeric(wh, spark, sf_dir):
    """The seller scorecard as it arrives in text form, coerced back to numbers."""
    from mercato.functions.coerce import coerce_numeric

    view = wh["vw_seller_scorecard"]
    as_text = view.select(*[F.col(c).cast("string").alias(c) for c in view.columns])
    return coerce_numeric(as_text)


@query("sla_chart_rows")
def _sla_chart_rows(wh, spark, sf_dir):
    from mercato.functions.coerce import drop_missing

    return drop_missing(wh["vw_delivery_sla"], "on_time_pct")


@query("coerce_text_columns")
def _coerce_text_columns(wh, spark, sf_dir):
    """Columns that look like numbers: with Java suffixes, too wide for bigint, whole, with points."""
    from mercato.functions.coerce import coerce_numeric
    from mercato.sources.testdata import read_test_table

    key = F.col("s_suppkey").cast("string")
    return coerce_numeric(read_test_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(key, F.lit("d")).alias("suffixed"),
        F.concat(F.lit("12345678901234567890"), F.lpad(key, 9, "0")).alias("wide"),
        key.alias("whole"), F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("points")))


@query("trend_chart_rows")
def _trend_chart_rows(wh, spark, sf_dir):
    """The monthly trend as it travels (period as text), its period turned back into a date."""
    from mercato.functions.dates import period_date

    points = reports.revenue_trend(wh, "month")
    return points.withColumn("period", F.col("period").cast("string")).withColumn(
        "period", period_date(F.col("period")))


# ---- streaming ---------------------------------------------------------------

@query("access_audit_stream")
def _access_audit_stream(wh, spark, sf_dir):
    """Events as a file stream -> access decisions -> exactly-once audit sink."""
    import uuid

    from mercato.plans.audit import read_audit, without_zone
    from mercato.session import scratch_path
    from mercato.sources.activity import requests_from_events, users_from_events
    from mercato.streaming.audit_stream import decisions_stream, file_stream, start_audit_stream

    static_events = _events(spark, sf_dir)
    stream = file_stream(spark, sf_dir, static_events.schema, glob="events.parquet")
    decisions = decisions_stream(requests_from_events(stream), users_from_events(static_events),
                                 spark)
    audit_path = scratch_path(spark, f"mercato/audit-{uuid.uuid4().hex}")
    start_audit_stream(decisions, audit_path).awaitTermination()
    return without_zone(read_audit(spark, audit_path))


@query("query_audit_stream")
def _query_audit_stream(wh, spark, sf_dir):
    """Events as a file stream -> submitted statements -> screen -> audit sink."""
    import uuid

    from mercato.plans.audit import read_audit, without_zone
    from mercato.session import scratch_path
    from mercato.sources.activity import query_log_from_events, users_from_events
    from mercato.streaming.audit_stream import file_stream, query_audit_stream, start_audit_stream

    static_events = _events(spark, sf_dir)
    stream = file_stream(spark, sf_dir, static_events.schema, glob="events.parquet")
    audited = query_audit_stream(query_log_from_events(stream), users_from_events(static_events))
    audit_path = scratch_path(spark, f"mercato/query-audit-{uuid.uuid4().hex}")
    start_audit_stream(audited, audit_path).awaitTermination()
    return without_zone(read_audit(spark, audit_path))
