"""The reference's report invariants, on the lazily built warehouse."""

import datetime as dt
from decimal import Decimal

import pytest

from mercato.plans import reports
from mercato.plans.registry import warehouse_for
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def wh(spark):
    return warehouse_for(spark, SF_ORACLE)


@pytest.mark.parametrize("gran", ["day", "week", "month"])
def test_periods_sorted_and_running_total(wh, gran):
    pts = reports.revenue_trend(wh, gran).orderBy("period").collect()
    assert pts
    running = Decimal(0)
    for p in pts:
        running += p["revenue"]
        assert p["running_total_revenue"] == running
    if gran == "week":
        assert all(p["period"].weekday() == 0 for p in pts)


def test_date_bounds(wh):
    pts = reports.revenue_trend(wh, "day", "1997-03-01", "1997-03-31").collect()
    assert pts
    assert all(dt.date(1997, 3, 1) <= p["period"] <= dt.date(1997, 3, 31) for p in pts)
    first = min(pts, key=lambda p: p["period"])
    assert first["mom_growth_pct"] is None
    assert first["running_total_revenue"] == first["revenue"]


def test_top_categories_ranks(wh):
    top = reports.top_categories(wh, 5).collect()
    assert [r["revenue_rank"] for r in top] == sorted(r["revenue_rank"] for r in top)
    revs = [r["revenue"] for r in top]
    assert revs == sorted(revs, reverse=True)
    assert len(reports.top_categories(wh, 2).collect()) == 2


def test_seller_limit_and_order(wh):
    top = reports.seller_scorecard(wh, 20).collect()
    assert len(top) == 20
    assert [r["revenue_rank"] for r in top][0] == 1
    revs = [r["revenue"] for r in top]
    assert revs == sorted(revs, reverse=True)


def test_aov_is_revenue_over_orders(wh):
    o = reports.aov_overall(wh).first()
    assert abs(o["aov"] - float(o["revenue"]) / o["orders"]) < 1e-9
    for r in reports.aov_by_category(wh).collect():
        assert abs(r["aov"] - float(r["revenue"]) / r["orders"]) < 1e-9
    for r in reports.aov_by_payment_type(wh).collect():
        assert abs(r["aov"] - float(r["revenue"]) / r["orders"]) < 1e-9


def test_percentages_and_scores_in_range(wh):
    sla = reports.delivery_sla(wh)
    for r in sla["by_state"].collect() + sla["overall"].collect():
        assert r["on_time_pct"] is None or 0 <= r["on_time_pct"] <= 100
    rc = reports.repeat_customers(wh).first()
    assert 0 <= rc["repeat_rate_pct"] <= 100
    assert 0 <= rc["repeat_revenue_share_pct"] <= 100
    for r in wh["vw_category_performance"].collect():
        assert 1 <= r["avg_review_score"] <= 5
        assert 0 <= r["revenue_share_pct"] <= 100


def test_object_counts(wh):
    got = {r["object"]: r["count"] for r in reports.object_counts(wh).collect()}
    assert set(got) == {"fct_order_items", "dim_product", "dim_customer", "dim_seller",
                        "dim_date"}
    assert got["fct_order_items"] == wh.fact.count()


def test_trend_bound_types(wh):
    a = reports.revenue_trend(wh, "month", dt.date(1997, 1, 1), dt.date(1997, 6, 30)).collect()
    b = reports.revenue_trend(wh, "month", dt.datetime(1997, 1, 1, 15), "1997-06-30").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert len(a) == 6
    assert reports.revenue_trend(wh, "day", "1997-02-01", "1997-01-01").count() == 0
    with pytest.raises(ValueError):
        reports.revenue_trend(wh, "month", "not-a-date")
