"""Further golden rows: one small table set per quirk."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import make_tables

from shelfwise.functions import expressions as X
from shelfwise.functions.filters import Filters
from shelfwise.operators import reports as R
from shelfwise.operators import rules as P

SITE = [(1, "Alpha", "Loc", "West", None)]
DAY = dt.datetime(2024, 1, 5)


def _d(x):
    return Decimal(x)


def test_categories_of_equal_name_and_code_merge(spark):
    t = make_tables(
        spark, warehouse=SITE, category=[(1, "Food", "F"), (2, "Food", "F"), (3, "Food", "G")],
        product=[(10, 1, "a", None, None), (11, 2, "b", None, None), (12, 3, "c", None, None)],
        salestransaction=[(1, None, 1, DAY, _d("6.00"))],
        salestransactionitem=[(1, 1, 10, 1, None, _d("1.00")), (2, 1, 11, 2, None, _d("2.00")), (3, 1, 12, 3, None, _d("3.00"))])
    assert {tuple(r) for r in R.category_revenue(t, Filters()).collect()} == {("Food", "F", 3.0, 3, 1), ("Food", "G", 3.0, 3, 1)}


def test_unknown_levels_and_products_without_category_raise_no_alert(spark):
    t = make_tables(
        spark, warehouse=SITE, category=[(1, "Food", "F")],
        product=[(10, 1, "a", None, None), (11, None, "b", None, None), (12, 9, "c", None, None)],
        inventory=[(1, 10, None, 5), (1, 10, 3, None), (1, 11, 0, 5), (1, 12, 0, 5), (1, 10, 2, 5)])
    assert [tuple(r) for r in R.low_inventory(t, Filters()).collect()] == [("Alpha", "a", 2, 5, None, None, X.RESTOCK_NOW)]
    # the copilot's rule does not ask for a category
    assert sorted(r.product_name for r in P.rule_reorder_contacts(t).collect()) == ["a", "b", "c"]


def test_promotion_reads_keys_and_unsold_products(spark):
    t = make_tables(
        spark, warehouse=SITE, category=[(1, "Food", "F")],
        product=[(10, 1, "key", None, '{"winterproof": false}'), (11, 1, "none", None, None), (12, 1, "unsold", _d("2.00"), None)],
        inventory=[(1, 10, 40, 5), (1, 11, 40, 5), (1, 12, 60, 5)],
        salestransactionitem=[(1, 1, 10, 9, None, _d("1.00")), (2, 1, 11, 9, None, _d("1.00"))])
    got = {r.product_name: (r.units_sold, r.promotion_recommendation) for r in R.promotion_candidates(t, Filters()).collect()}
    assert got == {"key": (9, X.SEASONAL), "none": (9, X.HEALTHY_INVENTORY), "unsold": (0, X.OVERSTOCK)}
    assert [tuple(r)[1:] for r in P.trapped_capital(t).collect()] == [(12, "Alpha", "unsold", 60, 0, 2.0, 120.0)]


def test_positions_follow_the_report_order(golden):
    rows = [(r.warehouse_name, r.position, r.inventory_status) for r in R.low_inventory_ordered(golden, Filters()).collect()]
    assert sorted(rows)[:2] == [("Alpha", 1, X.OUT_OF_STOCK), ("Alpha", 2, X.OUT_OF_STOCK)]
    bottom = R.warehouse_category_bottom(golden, Filters(start_date="2024-01-01", end_date="2024-01-31"), 2).collect()
    assert [(r.warehouse_name, r.category_name, r.position) for r in sorted(bottom, key=lambda r: r.position)] == \
        [("Alpha", "Grocery", 1), ("Alpha", "Outdoor", 2)]
