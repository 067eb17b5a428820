"""The SQL screen (statements the reference's tests submit, plus ours) and the
guarded runner's second wall."""

import pytest
from pyspark.sql import functions as F

from mercato.functions.text import clean_sql_text
from mercato.operators import screen as S
from mercato.plans.adhoc import (DEFAULT_MAX_ROWS, GuardrailError, generated_query,
                                 run_read_only)
from mercato.plans.registry import warehouse_for
from tests.conftest import SF_SMALL

ONLY = S.NOT_READ_ONLY
CASES = [
    ("DELETE FROM analytics.fct_order_items", ONLY),
    ("UPDATE analytics.dim_product SET category = 'x'", ONLY),
    ("DROP TABLE analytics.fct_order_items", ONLY),
    ("TRUNCATE analytics.fct_order_items", ONLY),
    ("SELECT 1; DROP TABLE analytics.dim_product", S.MULTIPLE),
    ("SELECT * FROM raw.orders", "table not allowed: raw.orders"),
    ("SELECT * FROM app.users", "table not allowed: app.users"),
    ("SELECT * FROM pg_catalog.pg_roles", "table not allowed: pg_catalog.pg_roles"),
    ("SELECT * FROM vw_category_performance -- exfiltrate", S.COMMENTS),
    ("INSERT INTO analytics.dim_seller VALUES ('x')", ONLY),
    ("SELECT category, revenue FROM vw_category_performance ORDER BY revenue DESC LIMIT 5", None),
    ("SELECT order_month, revenue FROM vw_monthly_revenue WHERE EXTRACT(year FROM order_month)"
     " = 1997 ORDER BY order_month LIMIT 12", None),
    ("SELECT order_id FROM fct_order_items", None),
    ("SELECT 1", None),
    ("WITH t AS (SELECT * FROM analytics.dim_date) SELECT * FROM t;;", None),
    ("SELECT 1; ;", S.MULTIPLE),
    ("  \n\t ", S.EMPTY),
    (None, S.EMPTY),
    (";", ONLY),
    ("SELECT * FROM vw_delivery_sla a, raw.orders b", None),
    ("SELECT 'set' AS x", S.FORBIDDEN),
    ("SELECT * FROM analytics.a.b", "table not allowed: analytics.a.b"),
    ("select * from Raw.Orders", "table not allowed: Raw.Orders"),
    ("SELECT 1 /* hidden */", S.COMMENTS),
    ("SELECT x FROM dim_date JOIN raw.orders ON true", "table not allowed: raw.orders"),
]


def test_screen_reasons(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, sql string")
    got = {r["id"]: (r["verdict"], r["reason"]) for r in S.screen_queries(df).collect()}
    for i, (sql, reason) in enumerate(CASES):
        assert got[i] == ("allowed" if reason is None else "denied", reason), sql


def test_fences_are_removed(spark):
    text = "```sql\nSELECT category FROM vw_category_performance LIMIT 3\n```"
    got = spark.range(1).select(clean_sql_text(F.lit(text)).alias("s")).first()["s"]
    assert got == "SELECT category FROM vw_category_performance LIMIT 3"


@pytest.fixture(scope="module")
def wh(spark):
    return warehouse_for(spark, SF_SMALL)


def test_run_caps_rows(spark, wh):
    res = run_read_only(wh, spark, "SELECT order_id FROM fct_order_items")
    assert res.frame.count() == DEFAULT_MAX_ROWS
    assert run_read_only(wh, spark, "SELECT order_id FROM fct_order_items",
                         max_rows=7).frame.count() == 7
    assert run_read_only(wh, spark, "SELECT order_id FROM fct_order_items",
                         max_rows=0).frame.count() == DEFAULT_MAX_ROWS


def test_extract_is_not_a_table(spark, wh):
    res = run_read_only(wh, spark, CASES[11][0])
    assert res.frame.count() == 12


def test_qualified_names_and_ctes_run(spark, wh):
    res = run_read_only(wh, spark, CASES[14][0])
    assert res.frame.count() > 0


@pytest.mark.parametrize("sql", [
    "SELECT * FROM vw_delivery_sla a, raw.orders b",       # passes screen; no such view
    "SELECT * FROM vw_delivery_sla a, orders b",
])
def test_second_wall_blocks_other_tables(spark, wh, sql):
    spark.range(3).createOrReplaceTempView("orders")       # parent-session view
    with pytest.raises(Exception) as exc:
        run_read_only(wh, spark, sql).frame.collect()
    assert not isinstance(exc.value, GuardrailError)


def test_file_paths_and_java_calls_are_blocked(spark, wh, scratch):
    spark.range(3).write.parquet(scratch + "/p")
    with pytest.raises(Exception):
        run_read_only(wh, spark, f"SELECT * FROM dim_date, parquet.`{scratch}/p`").frame.collect()
    with pytest.raises(GuardrailError):
        run_read_only(wh, spark, "SELECT reflect('java.lang.System', 'getenv') FROM dim_date")
    with pytest.raises(GuardrailError):
        run_read_only(wh, spark, "SELECT java_method('java.lang.System', 'exit', 1)")


def test_rejected_statement_raises_with_reason(spark, wh):
    with pytest.raises(GuardrailError, match="table not allowed: raw.orders"):
        run_read_only(wh, spark, "SELECT * FROM raw.orders")


def test_generated_query_path(spark, wh):
    out = generated_query(wh, spark, "top categories",
                          "```sql\nSELECT category FROM vw_category_performance LIMIT 3\n```")
    assert out["sql"] == "SELECT category FROM vw_category_performance LIMIT 3"
    assert out["frame"].count() == 3


def test_run_and_audit_outcomes(spark, wh):
    import datetime as dt

    from mercato.plans.adhoc import run_and_audit

    t = dt.datetime(2024, 1, 1)
    ok = run_and_audit(wh, spark, 1, "a", "analyst", "SELECT 1 AS x", t)
    assert ok.audit[5] == "allowed" and ok.rows[0]["x"] == 1 and ok.audit[4] == "SELECT 1 AS x"
    denied = run_and_audit(wh, spark, 2, "a", "analyst", "DROP TABLE x", t)
    assert denied.rows is None and denied.audit[5] == "denied"
    assert denied.audit[4] == "DROP TABLE x -> " + S.NOT_READ_ONLY
    err = run_and_audit(wh, spark, 3, "a", "analyst",
                        "SELECT * FROM vw_delivery_sla a, raw.orders b", t)
    assert err.rows is None and err.audit[5] == "error"
    assert err.audit[4].startswith("SELECT * FROM vw_delivery_sla a, raw.orders b -> ")
    assert "raw" in err.audit[4] and "\n" in err.audit[4]  # the whole message
    viewer = run_and_audit(wh, spark, 4, "v", "viewer", "SELECT 1", t)
    assert viewer.rows is None and viewer.audit[4:6] == ("SELECT 1 -> role may not use this route", "denied")


def test_submitted_queries_are_authorised_and_stored(spark, wh, scratch):
    import datetime as dt

    from mercato.plans.adhoc import submit_query
    from mercato.plans.audit import read_audit

    users = spark.createDataFrame([("ana", "analyst", True), ("vic", "viewer", True), ("off", "admin", False)],
                                  "username string, role string, is_active boolean")
    t = dt.datetime(2024, 1, 1)
    for i, (who, sql) in enumerate([("ana", "SELECT 1 AS x"), ("vic", "SELECT 1"), ("off", "SELECT 1"),
                                    ("nobody", "SELECT 1"), ("ana", "DROP TABLE x"),
                                    ("ana", "SELECT no_such_column FROM dim_date")]):
        submit_query(wh, spark, users, scratch + "/audit", i, who, sql, t)
    rows = {r["id"]: r for r in read_audit(spark, scratch + "/audit").collect()}
    assert [rows[i]["status"] for i in range(6)] == ["allowed", "denied", "denied", "denied", "denied", "error"]
    assert rows[2]["role"] is None and rows[1]["role"] == "viewer" and "no_such_column" in rows[5]["detail"]


@pytest.mark.parametrize("sql", [
    "SELECT TRANSFORM(year) USING 'id -u' AS (x STRING) FROM dim_date",
    "SELECT * FROM (SELECT TRANSFORM(year) USING 'cat' AS (x STRING) FROM dim_date) t",
    "WITH w AS (SELECT TRANSFORM(year) USING 'cat' AS (x STRING) FROM dim_date) SELECT * FROM w",
    "SELECT s.* FROM dim_seller a, global_temp.secret_tab s",
    "SELECT 1 FROM dim_seller WHERE seller_id IN (SELECT s.x FROM dim_seller a, global_temp.secret_tab s)",
    "WITH w AS (SELECT s.x FROM dim_seller a, global_temp.secret_tab s) SELECT * FROM w",
    "SELECT (SELECT max(s.x) FROM dim_seller a, global_temp.secret_tab s) AS x FROM dim_date",
    "SELECT * FROM dim_seller a, secret_kept s",
    "SELECT * FROM dim_seller a, default.secret_kept s",
    "SELECT * FROM dim_date a, range(5) b",
    "SELECT 1 FROM dim_date WHERE year IN (SELECT b.id FROM dim_date a, range(5) b)",
    "SELECT * FROM dim_date a, explode(array(1, 2)) b",
])
def test_foreign_relations_and_commands_are_refused(spark, wh, scratch, sql):
    spark.createDataFrame([("secret",)], "x string").createOrReplaceGlobalTempView("secret_tab")
    if not spark.catalog.tableExists("secret_kept"):
        spark.createDataFrame([("secret",)], "x string").write.option(
            "path", scratch + "/kept").saveAsTable("secret_kept")
    with pytest.raises(GuardrailError):
        run_read_only(wh, spark, sql)


@pytest.mark.parametrize("sql,n", [
    ("WITH w AS (SELECT year FROM dim_date), v AS (SELECT * FROM w) SELECT DISTINCT year FROM v WHERE year = 1997", 1),
    ("SELECT year FROM dim_date WHERE date_key = (SELECT max(date_key) FROM dim_date)", 1),
    ("SELECT a.seller_id FROM dim_seller a JOIN vw_seller_scorecard b ON a.seller_id = b.seller_id LIMIT 2", 2),
    ("SELECT 1 AS one", 1),
    ("SELECT x FROM dim_date LATERAL VIEW explode(array(1, 2)) t AS x LIMIT 3", 3),
])
def test_allowed_shapes_still_run(spark, wh, sql, n):
    assert run_read_only(wh, spark, sql).frame.count() == n


def test_row_cap_is_bounded(spark, wh):
    with pytest.raises(ValueError):
        run_read_only(wh, spark, "SELECT 1", max_rows=10 ** 9)


def test_bound_parameters(spark, wh):
    res = run_read_only(wh, spark, "SELECT date_key FROM dim_date WHERE year = :y", args={"y": 1997})
    assert res.frame.count() == 365


def test_answer_and_audit(spark, wh):
    import datetime as dt

    from mercato.plans.adhoc import answer_and_audit, answer_question

    fenced = "```sql\nSELECT category FROM vw_category_performance LIMIT 3\n```"
    ans = answer_question(wh, spark, "top?", fenced)
    assert ans["row_count"] == 3 and ans["sql"].startswith("SELECT category")
    t = dt.datetime(2024, 1, 1)
    ok = answer_and_audit(wh, spark, 1, "a", "analyst", "top?", fenced, t)
    assert ok.audit[4:6] == ("top? => SELECT category FROM vw_category_performance LIMIT 3",
                             "allowed")
    no = answer_and_audit(wh, spark, 4, "v", "viewer", "top?", fenced, t)
    assert no.rows is None and no.audit[4:6] == ("top? -> role may not use this route", "denied")
    bad = answer_and_audit(wh, spark, 2, "a", "analyst", "drop?", "DROP TABLE x", t)
    assert bad.audit[4:6] == ("drop? -> " + S.NOT_READ_ONLY, "denied")
    err = answer_and_audit(wh, spark, 3, "a", "analyst", "join?",
                           "SELECT * FROM vw_delivery_sla a, raw.orders b", t)
    assert err.audit[5] == "error" and err.audit[4].startswith("join? -> ")


def test_unqualify_keeps_string_literals():
    from mercato.plans.adhoc import unqualify

    assert unqualify("SELECT 'analytics.x' AS a, b FROM Analytics.dim_date") == \
        "SELECT 'analytics.x' AS a, b FROM dim_date"
    assert unqualify("SELECT 'it''s analytics.y' FROM analytics.t JOIN analytics.u") == \
        "SELECT 'it''s analytics.y' FROM t JOIN u"
    assert unqualify('SELECT "analytics.a" AS s, `analytics.b` FROM `analytics` . t, my_analytics.u') == \
        'SELECT "analytics.a" AS s, `analytics.b` FROM t, my_analytics.u'
    assert unqualify("SELECT 'a\\'analytics.b' FROM analytics.t -- analytics.c") == \
        "SELECT 'a\\'analytics.b' FROM t -- analytics.c"


def test_literal_with_qualifier_text_survives(spark, wh):
    res = run_read_only(wh, spark, "SELECT 'analytics.dim_date' AS s FROM analytics.dim_date LIMIT 1")
    assert res.frame.first()["s"] == "analytics.dim_date"
