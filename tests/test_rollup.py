"""Reports from the roll-up equal the direct reports, whatever the filters and the order of batches."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace
from decimal import Decimal

import pytest
from conftest import make_tables
from pyspark.sql import functions as F

from shelfwise.functions.filters import Filters
from shelfwise.operators import reports as R
from shelfwise.operators.rollup import SalesRollup, arriving_sales


def _random_sales(spark, seed, n=60):
    """Sales with NULL dates, warehouses and amounts, unknown products, and categories that share a name or a whole row."""
    rng = random.Random(seed)
    categories = [(1, "Food", "F1"), (2, "Food", "F2"), (3, "Food", "F1"), (4, None, "N"), (5, "Tools", None)]
    money = lambda: rng.choice([None, Decimal(rng.randint(1, 9999)) / 100])
    sales, items = [], []
    for k in range(n):
        day = rng.choice([None, dt.datetime(2024, rng.randint(1, 4), rng.randint(1, 28), rng.choice([0, 23]), 59)])
        sales.append((k, None, rng.choice([None, 99, *range(6)]), day, money()))
        for _ in range(rng.randint(0, 4)):
            items.append((len(items), k, rng.choice([77, *range(8)]), rng.choice([None, 1, 5]), None, money()))
    items += [(len(items) + j, n + j, 1, 1, None, Decimal(1)) for j in range(3)]  # of unknown transactions
    return make_tables(
        spark, category=categories, product=[(p, rng.choice([None, 1, 2, 3, 4, 5]), f"P{p}", None, None) for p in range(8)],
        warehouse=[(w, f"W{w // 2}", "L", "AB"[w % 2], None) for w in range(8)], salestransaction=sales, salestransactionitem=items)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _random_filters(rng):
    start = dt.date(2024, rng.randint(1, 4), rng.randint(1, 28))
    return Filters(region=rng.choice(["All", "A", "B"]), warehouse=rng.choice(["All", "All", "W1", "none"]),
                   category=rng.choice(["All", "Food", "Tools"]), start_date=rng.choice([None, start]),
                   end_date=rng.choice([None, start + dt.timedelta(days=rng.randint(0, 60))]))


@pytest.mark.parametrize("seed", range(3))
def test_reports_equal_the_direct_ones(spark, tmp_path, seed):
    t = _random_sales(spark, seed)
    rollup = arriving_sales(t, str(tmp_path), batches=2)
    rng = random.Random(100 + seed)
    for f in [Filters(), Filters(category="Food"), *(_random_filters(rng) for _ in range(4))]:
        assert _rows(rollup.category_revenue(f)) == _rows(R.category_revenue(t, f)), f
        assert _rows(rollup.warehouse_performance(f)) == _rows(R.warehouse_performance(t, f)), f
        assert _rows(rollup.warehouse_category(f)) == _rows(R.warehouse_category(t, f)), f


def test_snapshots_and_repeated_epochs(spark, tmp_path, monkeypatch):
    from shelfwise.streaming.sources import Sums
    monkeypatch.setattr(Sums, "EVERY", 2)
    t = _random_sales(spark, 9)
    rollup = SalesRollup(t, str(tmp_path))
    batches = [replace(t, salestransaction=t.salestransaction.where(F.col("transactionid") % 3 == k),
                       salestransactionitem=t.salestransactionitem.where(F.col("transactionid") % 3 == k)) for k in (2, 0, 1)]
    for epoch, batch in enumerate(batches):
        rollup.add(batch, epoch)
    rollup.add(batches[2], 2)  # a run whose commit was lost
    assert len(rollup.categories.folders()) == 2  # one snapshot, one delta
    assert _rows(rollup.category_revenue()) == _rows(R.category_revenue(t))


def test_without_batches(spark, tmp_path):
    t = _random_sales(spark, 1, n=0)
    rollup = SalesRollup(t, str(tmp_path))
    assert rollup.category_revenue().count() == rollup.warehouse_category().count() == 0
    assert _rows(rollup.warehouse_performance()) == _rows(R.warehouse_performance(replace(t, salestransaction=t.salestransaction.where("false"))))


def test_a_date_range_reaches_the_scan(spark, tmp_path):
    rollup = arriving_sales(_random_sales(spark, 2), str(tmp_path), batches=1)
    plan = rollup.category_revenue(Filters(start_date="2024-02-01", end_date="2024-02-03"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(day), GreaterThanOrEqual(day,2024-02-01)" in plan
