"""Every registered key against its DuckDB oracle, as the driver checks them.

Runs on sf0.001 to stay quick; ``python tests/harness.py /root/testdata/sf0.01``
runs the same comparison at the driver's scale.
"""

from __future__ import annotations

import pytest

from conftest import SMALL_SF
from harness import compare, duckdb_connection
from shelfwise.plans.registry import named_queries


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMALL_SF)


@pytest.mark.parametrize("key", list(named_queries()))
def test_matches_oracle(spark, con, key):
    result = compare(spark, SMALL_SF, key, con)
    assert result["status"] in ("match", "rows-only"), result


def test_every_key_has_an_oracle():
    assert {k for k, q in named_queries().items() if q.oracle is None} == set()


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["category_name", "department_code", "total_revenue", "total_units_sold",
                          "transaction_count"]
    assert df.count() > 0
    assert set(named_queries()) <= set(entry.queries()) and set(named_queries()) <= set(entry.oracle_sql())
