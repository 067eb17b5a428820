"""Hand-made raw tables of a few rows for edge cases (built per test)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from mercato.schemas import RAW_SCHEMAS


def ts(y, m, d, h=0):
    return dt.datetime(y, m, d, h)


def raw_tables(spark, orders=None, items=None, reviews=None, payments=None, customers=None,
               products=None, sellers=None, translation=None) -> dict:
    """Raw tables from row lists (missing ones default to small consistent rows)."""
    orders = orders if orders is not None else [
        ("o1", "c1", "delivered", ts(2017, 1, 5), ts(2017, 1, 5, 1), ts(2017, 1, 6),
         ts(2017, 1, 10), ts(2017, 2, 4)),
    ]
    items = items if items is not None else [
        ("o1", 1, "p1", "s1", ts(2017, 1, 7), Decimal("10.00"), Decimal("1.00")),
    ]
    reviews = reviews if reviews is not None else [
        ("r1", "o1", 5, None, None, ts(2017, 1, 11), ts(2017, 1, 12)),
    ]
    payments = payments if payments is not None else [("o1", 1, "credit_card", 1,
                                                        Decimal("11.00"))]
    customers = customers if customers is not None else [
        (o[1], "person-" + o[1], "01000", "city", "SP") for o in orders]
    products = products if products is not None else [
        ("p1", "cat_a", 10, 100, 1, 500, 10, 11, 12),
        ("p2", "cat_b", 10, 100, 1, 500, 10, 11, 12),
        ("p3", "cat_c", 10, 100, 1, 500, 10, 11, 12),
    ]
    sellers = sellers if sellers is not None else [("s1", "02000", "city", "RJ"),
                                                   ("s2", "03000", "city", "MG")]
    translation = translation if translation is not None else [
        ("cat_a", "a_en"), ("cat_b", "b_en"), ("cat_c", "c_en")]
    data = {
        "orders": orders, "order_items": items, "order_reviews": reviews,
        "order_payments": payments, "customers": customers, "products": products,
        "sellers": sellers, "product_category_name_translation": translation,
        "geolocation": [("01000", 1.0, -1.0, "city", "SP")],
    }
    return {t: spark.createDataFrame(rows, RAW_SCHEMAS[t]) for t, rows in data.items()}


def order(oid, status="delivered", purchase=None, delivered=None, estimate=None, cust=None):
    purchase = purchase or ts(2017, 1, 5)
    return (oid, cust or "c-" + oid, status, purchase, purchase, purchase, delivered, estimate)


def item(oid, n, product="p1", seller="s1", price="10.00", freight="0.00"):
    return (oid, n, product, seller, ts(2017, 1, 7), Decimal(price), Decimal(freight))
