"""Hand-written rows (FIXTURES.md §3) as a nine-table bundle."""

from __future__ import annotations

from datetime import datetime

from shipwise.schemas import SCHEMAS
from shipwise.tables import Tables


def ts(s: str | None):
    return None if s is None else datetime.strptime(s, "%Y-%m-%d %H:%M")


# (order id, purchase, carrier, delivered, estimated, status)
ORDERS = [
    ("h1", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-05 00:00", "2018-05-20 00:00", "delivered"),
    ("h2", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-06 00:00", "2018-05-20 00:00", "delivered"),
    ("h3", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-14 00:00", "2018-05-20 00:00", "delivered"),
    ("h4", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-19 12:00", "2018-05-20 00:00", "delivered"),
    ("h5", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-20 00:00", "2018-05-20 00:00", "delivered"),
    ("h6", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-21 00:00", "2018-05-20 00:00", "delivered"),
    ("h7", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-21 12:00", "2018-05-20 00:00", "delivered"),
    ("h8a", "2018-05-01 10:00", "2018-05-02 10:00", "2018-06-03 00:00", "2018-05-20 00:00", "delivered"),
    ("h8b", "2018-05-01 10:00", "2018-05-02 10:00", "2018-06-04 00:00", "2018-05-20 00:00", "delivered"),
    ("h9", "2018-05-01 10:00", None, None, "2018-05-20 00:00", "canceled"),
    ("h10", "2018-05-01 10:00", "2018-05-02 10:00", "2018-05-10 00:00", None, "delivered"),
    ("h11", "2018-05-01 10:00", None, "2018-05-10 00:00", "2018-05-20 00:00", "delivered"),
    ("h12", "2018-05-10 10:00", "2018-05-09 00:00", "2018-05-09 00:00", "2018-05-20 00:00", "delivered"),
    ("h13a", "2018-05-01 00:00", "2018-05-02 00:00", "2018-05-08 00:00", "2018-06-10 00:00", "delivered"),
    ("h13b", "2018-05-01 00:00", "2018-05-02 00:00", "2018-06-30 00:00", "2018-06-10 00:00", "delivered"),
]

# expected K13 bucket letter per order (None: outside ND)
BUCKET = {"h1": "A", "h2": "B", "h3": "C", "h4": "C", "h5": "D", "h6": "D", "h7": "E", "h8a": "F",
          "h8b": "G", "h9": None, "h10": None, "h11": "B", "h12": "B", "h13a": "A", "h13b": "G"}


def hand_tables(spark) -> Tables:
    orders = [(oid, "c1" if i % 2 else "c2", st, ts(p), ts(p), ts(c), ts(d), ts(e))
              for i, (oid, p, c, d, e, st) in enumerate(ORDERS)]
    customers = [("c1", "u1", "01037", "sao paulo", "SP"), ("c2", "u1", "20000", "rio", "RJ")]
    sellers = [("s1", "01000", "campinas", "SP"), ("s2", "30000", "belo horizonte", "MG")]
    # weights 500, 501, 2000, 5000, 10000, 10001, NULL; p8 has NULL category, p5 an untranslated one
    products = [(f"p{i}", cat, 10, 100, 1, w, 10, 10, 10) for i, (cat, w) in enumerate(
        [("bed", 500), ("bed", 501), ("toys", 2000), ("toys", 5000), ("auto", 10000), ("moveis", 10001),
         ("auto", None), ("bed", 300), (None, 700), ("bed", 900)])]
    translation = [("bed", "bed_bath"), ("toys", "toys_en"), ("auto", "auto_en")]
    items = []
    for i, (oid, *_rest) in enumerate(ORDERS):
        items.append((oid, 1, f"p{i % 10}", "s1", ts("2018-05-03 00:00"), 10.0 + i, 1.5))
    # a multi-item, multi-seller order with two reviews
    items.append(("h3", 2, "p8", "s2", ts("2018-05-03 00:00"), 20.0, 2.0))
    payments = [(oid, 1, "credit_card", 1, 10.0) for oid, *_r in ORDERS]
    reviews = [(f"r_{oid}", oid, 5, None, None, ts("2018-06-10 00:00"), ts("2018-06-11 00:00"))
               for oid, *_r in ORDERS if oid not in ("h9",)]
    reviews.append(("r_h3b", "h3", 1, "t", 'said "hi"\nthen left', ts("2018-06-10 00:00"), ts("2018-06-11 00:00")))

    def df(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])
    return Tables(category_translation=df("category_translation", translation),
                  customers=df("customers", customers), sellers=df("sellers", sellers),
                  products=df("products", products), orders=df("orders", orders),
                  order_items=df("order_items", items), order_payments=df("order_payments", payments),
                  order_reviews=df("order_reviews", reviews), geolocation=None)
