"""shipwise: order-fulfilment analytics as Spark DataFrame operators.

Every operator takes a :class:`~shipwise.tables.Tables` bundle (orders, items,
products, sellers, customers, payments, reviews, category names, locations) and
returns a lazy DataFrame:

>>> from shipwise.sources.files import read_tables
>>> from shipwise.operators import delivery
>>> t = read_tables(spark, "/data/marketplace", fmt="csv")
>>> delivery.delay_buckets(t).show()

Modules: ``sources`` (CSV/Parquet/catalog I/O, the test-data mapping),
``functions`` (column expressions, distributed ranks and percentiles, SQL
functions), ``operators`` (analyses, features, models, buffers, evaluation),
``plans`` (plan inspection), ``catalog`` (named queries) and ``run`` (the whole
workflow).
"""

__version__ = "0.1.0"
