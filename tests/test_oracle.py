"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from conftest import SF_SMALL
from shipwise import catalog
from shipwise.oracle.compare import compare

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    ok, msg = compare(df, duck, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_every_query_has_an_oracle_or_is_a_model():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert all(n.endswith("_boosted") or n.startswith(("m10_", "m19_")) for n in missing), missing
