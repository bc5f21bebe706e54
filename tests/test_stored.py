"""What the feature rows and the route models' frame are stored as, and that either way of joining gives the same rows."""

from shipwise.operators import model_reports as mr
from shipwise.operators.features import base_features, encoded_rows, model_frame, narrow_frame, split_rows
from shipwise.operators.models import ROUTE_ROWS
from shipwise.oracle.compare import spark_result


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_rows_are_read_by_column(star):
    told = plan(split_rows(star).groupBy("split").count())
    assert "FileScan parquet" in told and "Scan ExistingRDD" not in told and "product_weight_g" not in told
    assert "FileScan parquet" in plan(mr.comparison(star).test)


def test_narrow_frame_holds_the_columns_of_the_whole_frame(star):
    a, b = narrow_frame(star, ROUTE_ROWS), model_frame(star).select(*ROUTE_ROWS)
    assert a.columns == list(ROUTE_ROWS) and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() > 0
    c, d = encoded_rows(star), encoded_rows(star, columnar=False)
    assert c.columns == d.columns and c.exceptAll(d).isEmpty() and d.exceptAll(c).isEmpty()


def test_both_orders_of_joins_give_the_same_rows(star):
    a, b = spark_result(base_features(star)), spark_result(base_features(star, items_first=True))
    assert a[0] == b[0] and sorted(a[1], key=repr) == sorted(b[1], key=repr)
