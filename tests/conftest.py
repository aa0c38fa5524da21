from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL_SF = "/root/testdata/sf0.001"
ORACLE_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import build_session
    session = build_session("local[4]", shuffle_partitions=4, app_name="shelfwise-tests")
    # Tests have no cluster setting: give the session a checkpoint folder of its own.
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-test-ckpt-"))
    yield session
    session.stop()


def _d(x: str) -> Decimal:
    return Decimal(x)


def _ts(text: str | None):
    return None if text is None else dt.datetime.fromisoformat(text)


def make_tables(spark, **rows):
    """RetailTables from Python rows (missing tables are empty)."""
    from shelfwise.sources.catalog import RetailTables
    from shelfwise.sources.schema import SCHEMAS, TABLE_NAMES
    frames = {name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name]) for name in TABLE_NAMES}
    return RetailTables(spark=spark, **frames)


@pytest.fixture(scope="session")
def golden(spark):
    """The micro-fixture of FIXTURES.md §3.1."""
    return make_tables(
        spark,
        warehouse=[(1, "Alpha", "Loc A", "West", None), (2, "Beta", "Loc B", "West", None),
                   (3, "Gamma", "Loc C", "East", None), (4, "Delta", "Loc D", "East", None)],
        category=[(10, "Grocery", "G1"), (20, "Outdoor", "O1")],
        supplier=[(100, "S-One", "Ann", "a@x", None), (101, "S-Two", "Bob", "b@x", None)],
        product=[(1000, 10, "Milk", _d("2.50"), '{"season": "All"}'),
                 (1001, 20, "Coat", _d("80.00"), '{"season": "Winter"}'),
                 (1002, 20, "Tent", _d("120.00"), None)],
        productsupplier=[(1000, 100, _d("1.00"), 3), (1000, 101, _d("1.00"), None), (1001, 100, _d("50.00"), 14)],
        inventory=[(1, 1000, 0, 10), (1, 1001, 40, 10), (2, 1000, 12, 10), (2, 1002, 60, 5),
                   (3, 1001, 9, 10), (4, 1002, 5, 5)],
        salestransaction=[(1, None, 1, _ts("2024-01-05T10:00:00"), _d("100.00")),
                          (2, None, 1, _ts("2024-02-10T09:00:00"), _d("50.00")),
                          (3, None, 2, _ts("2024-01-31T23:59:59"), _d("150.00")),
                          (4, None, None, _ts("2024-01-10T00:00:00"), _d("30.00")),
                          (5, None, 3, _ts("2023-12-31T23:00:00"), _d("70.00")),
                          (6, None, 2, None, _d("25.00"))],
        salestransactionitem=[(1, 1, 1000, 4, None, _d("10.00")), (2, 1, 1001, 1, None, _d("80.00")),
                              (3, 1, 1000, 2, None, _d("5.00")), (4, 2, 1000, 3, None, _d("7.50")),
                              (5, 3, 1001, 1, None, _d("80.00")), (6, 4, 1000, 10, None, _d("25.00")),
                              (7, 5, 1002, 1, None, _d("120.00")), (8, 6, 1000, 1, None, _d("2.50"))],
    )


@pytest.fixture(scope="session")
def january():
    from shelfwise.functions.filters import Filters
    return Filters(start_date="2024-01-01", end_date="2024-01-31")


@pytest.fixture(scope="session")
def small_tables(spark):
    from shelfwise.sources.catalog import load_driver_tables
    return load_driver_tables(spark, SMALL_SF)
