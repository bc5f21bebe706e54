"""SQL functions for running the source's SQLite-dialect queries with
``spark.sql`` over the registered views (``tables.register_views``).

They are SQL-defined functions (``CREATE TEMPORARY FUNCTION ... RETURN``):
Spark inlines their expression into the plan, so they stay in whole-stage
codegen like any built-in; no Python or JVM UDF object is involved.

* ``julianday(ts)``: Julian day number of a timestamp, as SQLite's
  ``julianday``; differences of two values are day counts in floating point.
* ``days_between(later, earlier)``: exact ``later - earlier`` in days from an
  integer microsecond difference (the library's own definition, F3); prefer
  it where a half-day tie must round exactly.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Julian day number of the Unix epoch (1970-01-01 00:00 UTC).
UNIX_EPOCH_JULIAN_DAY = 2440587.5

_FUNCTIONS = {
    "julianday": (
        "ts TIMESTAMP_NTZ", "DOUBLE",
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 86400000000D "
        f"+ {UNIX_EPOCH_JULIAN_DAY}D"),
    "days_between": (
        "later TIMESTAMP_NTZ, earlier TIMESTAMP_NTZ", "DOUBLE",
        "timestampdiff(MICROSECOND, earlier, later) / 86400000000D"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (params, returns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return list(_FUNCTIONS)
