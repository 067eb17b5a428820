"""The stored order-level rollup against reports over the lines."""

import re
from decimal import Decimal

import pytest

from mercato.plans import reports
from mercato.plans.build import build, load_warehouse
from mercato.plans.model import lazy_warehouse
from mercato.sources.testdata import raw_from_testdata
from tests.conftest import SF_SMALL
from tests.fixtures import item, order, raw_tables, ts
from tests.test_plans import plan_of


def repeated_orders(spark):
    """o1 is on four dates (two of one week, one later in the month, one in the
    next) and once without a date; its second row is not delivered."""
    days = [ts(2017, 1, 2), ts(2017, 1, 4, 9), ts(2017, 1, 4, 21), ts(2017, 1, 25), ts(2017, 2, 1)]
    orders = [order("o1", purchase=d, cust="c1") for d in days]
    orders += [order("o1", "canceled", ts(2017, 1, 3), cust="c1"), order("o2", purchase=ts(2017, 1, 4)),
               order("o3", "canceled", ts(2017, 1, 4))]
    without = order("o1", cust="c1")
    orders.append((*without[:3], None, *without[4:]))
    without = order("o4")
    orders.append((*without[:3], None, *without[4:]))
    items = [item("o1", 1, price="10.00"), item("o1", 2, "p2", price="5.50", freight="1.25"),
             item("o2", 1, "p2"), item("o3", 1), item("o4", 1, "p3", price="7.00")]
    payments = [("o1", 1, "card", 1, 1), ("o1", 1, "voucher", 1, 1), ("o2", 1, "card", 1, 1),
                ("o4", 2, "card", 1, 1)]
    customers = [("c1", "u1", "01000", "city", "SP")] + [
        (f"c-o{i}", f"u{i}", "01000", "city", "SP") for i in (2, 3, 4)]
    payments = [(*p[:4], Decimal("1.00")) for p in payments]
    return raw_tables(spark, orders=orders, items=items, payments=payments, customers=customers)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    raw = repeated_orders(spark)
    root = str(tmp_path_factory.mktemp("rollup"))
    build(spark, raw, root)
    return lazy_warehouse(raw), load_warehouse(spark, root)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
@pytest.mark.parametrize("bounds", [(None, None), ("2017-01-04", None), (None, "2017-01-04"),
                                    ("2017-01-03", "2017-01-31"), ("2017-01-25", "2017-02-01"),
                                    ("2018-01-01", "2018-02-01")])
def test_trend_counts_a_repeated_order_once_a_period(both, granularity, bounds):
    lines, stored = both
    a = reports.revenue_trend(lines, granularity, *bounds)
    b = reports.revenue_trend(stored, granularity, *bounds)
    assert a.dtypes == b.dtypes
    assert rows(a) == rows(b)


@pytest.mark.parametrize("report", [reports.aov_overall, reports.aov_by_category,
                                    reports.aov_by_payment_type, lambda wh: wh["vw_monthly_revenue"]])
def test_reports_agree(both, report):
    lines, stored = both
    assert report(lines).dtypes == report(stored).dtypes  # stored columns may be null
    assert rows(report(lines)) == rows(report(stored))


def test_overall_counts_orders_not_rows(both):
    assert reports.aov_overall(both[1]).first()["orders"] == 3
    assert both[1].order_days.where("order_id = 'o1'").count() == 5


def test_no_order_warehouse(spark, tmp_path):
    raw = raw_tables(spark, orders=[order("o1", "canceled")], items=[item("o1", 1)])
    build(spark, raw, str(tmp_path))
    wh = load_warehouse(spark, str(tmp_path))
    assert wh.order_days.isEmpty() and reports.revenue_trend(wh, "week").isEmpty()
    assert reports.aov_overall(wh).first()["orders"] == 0


def test_reports_move_no_order_ids(spark, tmp_path):
    build(spark, raw_from_testdata(spark, SF_SMALL), str(tmp_path))
    wh = load_warehouse(spark, str(tmp_path))
    for df in (reports.revenue_trend(wh, "day"), reports.revenue_trend(wh, "month", "1996-03-15", "1998-06-30"),
               reports.aov_overall(wh), reports.aov_by_category(wh), wh["vw_monthly_revenue"]):
        plan = plan_of(df)
        assert not re.search(r"\border_id[#:]", plan) and "fct_order_items" not in plan
    plan = plan_of(reports.revenue_trend(wh, "month", "1996-03-15", "1998-06-30"))
    assert re.search(r"PartitionFilters: \[.*order_month.*>= 1996-03-01", plan)
