"""Edge cases of the fact, views and reports on hand-made rows."""

from decimal import Decimal

import pytest

from mercato.operators.keys import KeyViolation, assert_primary_key
from mercato.plans import reports
from mercato.plans.model import lazy_warehouse
from tests.fixtures import item, order, raw_tables, ts


def wh_of(spark, **kw):
    return lazy_warehouse(raw_tables(spark, **kw))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_fact_delivery_measures(spark):
    orders = [
        order("a", delivered=ts(2017, 1, 8, 3), estimate=ts(2017, 2, 1)),   # on time
        order("b", delivered=ts(2017, 3, 1), estimate=ts(2017, 2, 1)),      # late
        order("c", delivered=ts(2017, 1, 9), estimate=None),                # no estimate
        order("d", status="shipped"),                                       # not delivered
    ]
    items = [item(o[0], 1) for o in orders]
    fact = wh_of(spark, orders=orders, items=items, reviews=[]).fact
    got = {r["order_id"]: r for r in fact.collect()}
    assert got["a"]["on_time"] is True
    assert got["a"]["delivery_days"] == Decimal("3.13")        # 3 days 3 hours
    assert got["b"]["on_time"] is False
    assert got["c"]["on_time"] is False                        # NULL estimate -> false
    assert got["d"]["on_time"] is None and got["d"]["delivery_days"] is None
    assert got["a"]["item_revenue"] == Decimal("10.00")
    assert got["a"]["avg_review_score"] is None                 # order without review


def test_review_average_is_per_order(spark):
    reviews = [("r1", "o1", 4, None, None, ts(2017, 1, 1), None),
               ("r2", "o1", 5, None, None, ts(2017, 1, 1), None),
               ("r3", "o1", None, None, None, ts(2017, 1, 1), None)]
    fact = wh_of(spark, reviews=reviews).fact
    assert fact.first()["avg_review_score"] == Decimal("4.50")


def test_null_month_sorts_last_in_running_total(spark):
    orders = [order("a", purchase=ts(2017, 1, 5)), order("b", purchase=ts(2017, 2, 5)),
              ("n", "c-n", "delivered", None, None, None, None, None)]
    items = [item("a", 1, price="10.00"), item("b", 1, price="20.00"), item("n", 1, price="5.00")]
    view = wh_of(spark, orders=orders, items=items)["vw_monthly_revenue"]
    got = rows(view.orderBy("running_total_revenue"), "order_month", "running_total_revenue")
    assert [g[1] for g in got] == [Decimal("10.00"), Decimal("30.00"), Decimal("35.00")]
    assert got[-1][0] is None


def test_growth_null_after_zero_revenue(spark):
    orders = [order("a", purchase=ts(2017, 1, 5)), order("b", purchase=ts(2017, 2, 5)),
              order("c", purchase=ts(2017, 3, 5))]
    items = [item("a", 1, price="0.00"), item("b", 1, price="20.00"), item("c", 1, price="30.00")]
    view = wh_of(spark, orders=orders, items=items)["vw_monthly_revenue"]
    got = [r["mom_growth_pct"] for r in view.orderBy("order_month").collect()]
    assert got == [None, None, Decimal("50.00")]


def test_category_rank_ties_and_share(spark):
    orders = [order(o) for o in "abc"]
    items = [item("a", 1, product="p1", price="10.00"), item("b", 1, product="p2", price="10.00"),
             item("c", 1, product="p3", price="5.00")]
    view = wh_of(spark, orders=orders, items=items)["vw_category_performance"]
    got = sorted(rows(view, "category", "revenue_rank", "revenue_share_pct"))
    assert got == [("a_en", 1, Decimal("40.00")), ("b_en", 1, Decimal("40.00")),
                   ("c_en", 3, Decimal("20.00"))]


def test_category_fallbacks(spark):
    products = [("p1", "cat_x", 1, 1, 1, 1, 1, 1, 1), ("p2", None, 1, 1, 1, 1, 1, 1, 1)]
    dim = wh_of(spark, products=products)["dim_product"]
    assert sorted(rows(dim, "product_id", "category")) == [("p1", "cat_x"), ("p2", "unknown")]


def test_order_over_two_categories_counts_in_each(spark):
    items = [item("o1", 1, product="p1"), item("o1", 2, product="p2")]
    wh = wh_of(spark, items=items)
    got = sorted(rows(reports.aov_by_category(wh), "category", "orders"))
    assert got == [("a_en", 1), ("b_en", 1)]
    assert rows(reports.aov_overall(wh), "orders") == [(1,)]


def test_canceled_delivery_counts_in_sla_not_revenue(spark):
    orders = [order("a", status="canceled", delivered=ts(2017, 1, 9), estimate=ts(2017, 2, 1)),
              order("b", delivered=ts(2017, 1, 9), estimate=ts(2017, 2, 1))]
    items = [item("a", 1, price="7.00"), item("b", 1, price="3.00")]
    wh = wh_of(spark, orders=orders, items=items)
    assert rows(reports.delivery_sla_overall(wh), "delivered_items") == [(2,)]
    assert rows(reports.aov_overall(wh), "revenue") == [(Decimal("3.00"),)]


def test_no_repeat_customer_gives_null_repeat_revenue(spark):
    orders = [order("a", cust="c1"), order("b", cust="c2")]
    items = [item("a", 1), item("b", 1)]
    got = reports.repeat_customers(wh_of(spark, orders=orders, items=items)).first()
    assert got["repeat_customers"] == 0
    assert got["repeat_revenue"] is None
    assert got["repeat_rate_pct"] == Decimal("0.00")


def test_repeat_customer_is_the_person(spark):
    orders = [order("a", cust="c1"), order("b", cust="c2"), order("c", cust="c3")]
    customers = [("c1", "P", "1", "x", "SP"), ("c2", "P", "1", "x", "SP"),
                 ("c3", "Q", "1", "x", "RJ")]
    items = [item("a", 1), item("b", 1), item("c", 1)]
    got = reports.repeat_customers(wh_of(spark, orders=orders, items=items,
                                         customers=customers)).first()
    assert (got["total_customers"], got["repeat_customers"]) == (2, 1)
    assert got["repeat_rate_pct"] == Decimal("50.00")


def test_payment_type_uses_primary_payment_only(spark):
    payments = [("o1", 1, "boleto", 1, Decimal("11.00")), ("o1", 2, "voucher", 1, Decimal("1"))]
    got = rows(reports.aov_by_payment_type(wh_of(spark, payments=payments)),
               "payment_type", "orders")
    assert got == [("boleto", 1)]


def test_duplicate_key_fails(spark):
    products = [("p1", "a", 1, 1, 1, 1, 1, 1, 1), ("p1", "b", 1, 1, 1, 1, 1, 1, 1)]
    dim = wh_of(spark, products=products)["dim_product"]
    with pytest.raises(KeyViolation):
        assert_primary_key(dim, "product_id", "dim_product")


def test_dim_date_is_continuous(spark):
    orders = [order("a", purchase=ts(2017, 1, 30)), order("b", purchase=ts(2017, 2, 2, 23))]
    dd = wh_of(spark, orders=orders, items=[item("a", 1)])["dim_date"]
    got = rows(dd.orderBy("date_key"), "date_key", "iso_dow", "weekday_name", "is_weekend",
               "year_month")
    assert [str(g[0]) for g in got] == ["2017-01-30", "2017-01-31", "2017-02-01", "2017-02-02"]
    assert got[0][1:] == (1, "Monday   ", False, "2017-01")


def test_invalid_arguments_raise(spark):
    wh = wh_of(spark)
    with pytest.raises(ValueError):
        reports.revenue_trend(wh, "year")
    with pytest.raises(ValueError):
        reports.top_categories(wh, 0)
    with pytest.raises(ValueError):
        reports.seller_scorecard(wh, 101)
