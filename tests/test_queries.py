"""Every registered query against its SQL statement, on the smallest data and tiny slices."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.compare import run_pair
from tests.conftest import SMALL

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    ok, note = run_pair(spark, duck, SMALL, QUERIES[name], ORACLES.get(name))
    # an empty result may be right; differing columns or rows are not
    assert ok or "rows=0" in note and "only" not in note and "columns" not in note, note


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
