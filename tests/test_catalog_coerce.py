"""Catalogue listing of the isolated session and numeric coercion of text results."""

from mercato.functions.coerce import coerce_numeric, drop_missing, numeric_plan
from mercato.plans.adhoc import isolated_session
from mercato.plans.registry import warehouse_for
from mercato.schemas import ANALYTICS_OBJECTS
from mercato.sources.catalog import allowed_objects, catalog_columns, schema_text
from tests.conftest import SF_SMALL


def test_catalogue_lists_exactly_the_analytics_objects(spark):
    wh = warehouse_for(spark, SF_SMALL)
    session = isolated_session(wh, spark)
    assert allowed_objects(session) == set(ANALYTICS_OBJECTS)
    cols = catalog_columns(session)
    got = {(r["table"], r["ordinal"]): r["column"] for r in cols.collect()}
    assert got[("dim_date", 1)] == "date_key"
    assert got[("fct_order_items", 15)] == "item_revenue"
    notes = {r["table"]: r["note"] for r in cols.select("table", "note").distinct().collect()}
    assert notes["dim_date"] == "calendar"
    text = schema_text(session)
    assert "* vw_delivery_sla | on-time %" in text
    assert "    - customer_state: string" in text and text.count("* ") == len(ANALYTICS_OBJECTS)


def test_coercion_rules(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "a", None, "NaN", " 7 "), ("2", "2", "3", "4", "1", "8")],
        "ints string, floats string, mixed string, nulls string, nans string, padded string")
    assert numeric_plan(df) == {"ints": "bigint", "floats": "double", "padded": "bigint"}
    out = coerce_numeric(df)
    assert dict(out.dtypes) == {"ints": "bigint", "floats": "double", "mixed": "string",
                                "nulls": "string", "nans": "string", "padded": "bigint"}
    assert sorted(r["padded"] for r in out.collect()) == [7, 8]
    empty = spark.createDataFrame([], "a string")
    assert coerce_numeric(empty).dtypes == [("a", "string")]


def test_suffixes_and_wide_numbers(spark):
    df = spark.createDataFrame(
        [("12d", "5F", "12345678901234567890123", "1e3", ".5", "inf"), ("1", "2", "7", "2", "3.", "1")],
        "d string, f string, wide string, exponent string, point string, endless string")
    out = coerce_numeric(df)
    assert dict(out.dtypes) == {"d": "string", "f": "string", "wide": "double", "exponent": "double",
                                "point": "double", "endless": "double"}
    assert sorted(r["wide"] for r in out.collect()) == [7.0, 1.2345678901234568e22]


def test_drop_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "s string, on_time_pct double")
    assert [r["s"] for r in drop_missing(df, "on_time_pct").collect()] == ["a"]
