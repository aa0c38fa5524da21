"""Golden rows of the micro-fixture (FIXTURES.md §3.2), worked out by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from conftest import make_tables
from shelfwise.functions.filters import Filters
from shelfwise.operators import kpis as K
from shelfwise.operators import lookups as L
from shelfwise.operators import reports as R
from shelfwise.operators import rules as P
from shelfwise.operators import series as C


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_category_revenue(golden, january):
    got = rows(R.category_revenue(golden, january), "category_name", "department_code", "total_revenue",
               "total_units_sold", "transaction_count")
    assert got == [("Outdoor", "O1", 160.0, 2, 2), ("Grocery", "G1", 15.0, 6, 1)]


def test_warehouse_performance_open(golden, january):
    got = rows(R.warehouse_performance(golden, january), "warehouseid", "warehouse_name", "region",
               "total_revenue", "transaction_count", "regional_rank")
    assert got == [(2, "Beta", "West", 175.0, 2, 1), (1, "Alpha", "West", 100.0, 1, 2),
                   (4, "Delta", "East", 0.0, 0, 1)]


@pytest.mark.parametrize("category,expected", [
    ("Outdoor", [(2, 150.0, 1, 1), (1, 100.0, 1, 2)]),
    ("Grocery", [(1, 100.0, 1, 1), (2, 25.0, 1, 2)]),
])
def test_warehouse_performance_by_category(golden, category, expected):
    f = Filters(category=category, start_date="2024-01-01", end_date="2024-01-31")
    got = rows(R.warehouse_performance(golden, f), "warehouseid", "total_revenue", "transaction_count",
               "regional_rank")
    assert got == expected


def test_low_inventory(golden):
    got = rows(R.low_inventory(golden, Filters()), "warehouse_name", "product_name", "stockquantity",
               "reorderlevel", "leadtimedays", "supplier_name", "inventory_status")
    assert got[:4] == [("Alpha", "Milk", 0, 10, 3, "S-One", "Out of Stock"),
                       ("Alpha", "Milk", 0, 10, None, "S-Two", "Out of Stock"),
                       ("Gamma", "Coat", 9, 10, 14, "S-One", "Restock Now"),
                       ("Beta", "Milk", 12, 10, 3, "S-One", "Monitor Closely")]
    assert sorted(got[4:], key=str) == sorted([("Beta", "Milk", 12, 10, None, "S-Two", "Monitor Closely"),
                                               ("Delta", "Tent", 5, 5, None, None, "Monitor Closely")], key=str)


def test_low_inventory_metrics(golden):
    m = K.low_inventory_metrics(R.low_inventory(golden, Filters())).first()
    assert (m.alerted_items, m.restock_now, m.out_of_stock) == (6, 1, 2)


def test_warehouse_category(golden, january):
    got = rows(R.warehouse_category(golden, january), "warehouse_name", "category_name", "category_revenue",
               "units_sold", "transaction_count")
    assert got[0] == ("Alpha", "Grocery", 15.0, 6, 1)
    assert sorted(got[1:]) == [("Alpha", "Outdoor", 80.0, 1, 1), ("Beta", "Outdoor", 80.0, 1, 1)]


PROMO = [("Beta", "Tent", 60, 5, 1, "Overstock: Run Promotion"),
         ("Alpha", "Coat", 40, 10, 2, "Seasonal Clearance"),
         ("Beta", "Milk", 12, 10, 20, "Healthy Inventory"),
         ("Gamma", "Coat", 9, 10, 2, "Healthy Inventory"),
         ("Delta", "Tent", 5, 5, 1, "Healthy Inventory"),
         ("Alpha", "Milk", 0, 10, 20, "Healthy Inventory")]
PROMO_COLS = ("warehouse_name", "product_name", "stockquantity", "reorderlevel", "units_sold",
              "promotion_recommendation")


@pytest.mark.parametrize("f", [Filters(start_date="2024-01-01", end_date="2024-01-31"),
                               Filters(start_date="1990-01-01", end_date="1990-01-02"), Filters()])
def test_promotion_candidates_ignore_dates(golden, f):
    assert rows(R.promotion_candidates(golden, f), *PROMO_COLS) == PROMO


def test_promotion_candidates_scoped(golden, january):
    got = {(r[0], r[1]): r[4] for r in rows(R.promotion_candidates_scoped(golden, january), *PROMO_COLS)}
    assert got == {("Beta", "Tent"): 0, ("Alpha", "Coat"): 1, ("Beta", "Milk"): 0, ("Gamma", "Coat"): 0,
                   ("Delta", "Tent"): 0, ("Alpha", "Milk"): 6}


def test_promotion_metrics(golden):
    m = K.promotion_metrics(R.promotion_candidates(golden, Filters())).first()
    assert (m.row_count, m.total, m.highest, m.flagged) == (6, 126.0, 60.0, 2)
    assert K.promotion_flagged(R.promotion_candidates(golden, Filters())).count() == 2


def test_trapped_capital(golden):
    got = rows(P.trapped_capital(golden), "warehouse_name", "product_name", "trapped_capital")
    assert got == [("Beta", "Tent", 7200.0)]


def test_insight_category(golden, january):
    i = K.simple_insight(R.category_revenue(golden, january), "category_name", "total_revenue", "category").first()
    assert (i.strongest, i.strongest_value, i.weakest, i.weakest_value) == ("Outdoor", 160.0, "Grocery", 15.0)
    assert i.insight == ("Business insight: Outdoor is the strongest category in this view (160.00), "
                         "while Grocery is the weakest (15.00).")


def test_insight_single_and_empty(golden):
    one = Filters(category="Grocery", start_date="2024-01-01", end_date="2024-01-31")
    i = K.simple_insight(R.category_revenue(golden, one), "category_name", "total_revenue", "category").first()
    assert i.insight == ("Business insight: At this filtered level, Grocery is the sole contributor "
                         "with a value of 15.00.")
    none = Filters(start_date="1990-01-01", end_date="1990-01-02")
    i = K.simple_insight(R.category_revenue(golden, none), "category_name", "total_revenue", "category").first()
    assert i.row_count == 0 and i.insight == K.NO_RECORDS


def test_weakest_pair(golden, january):
    w = K.weakest_pair(R.warehouse_category(golden, january)).first()
    assert (w.warehouse_name, w.category_name) == ("Alpha", "Grocery")
    assert w.insight == "Business insight: Alpha / Grocery is the lowest-performing combination in this view (15.00)."


def test_revenue_share(golden, january):
    got = {r.category_name: r.share for r in C.revenue_share(R.category_revenue(golden, january)).collect()}
    assert got == pytest.approx({"Outdoor": 160 / 175, "Grocery": 15 / 175})


def test_metrics_and_chart_axis(golden, january):
    o1 = R.category_revenue(golden, january)
    m = K.show_metrics(o1, "total_revenue").first()
    assert (m.row_count, m.total, m.highest) == (2, 175.0, 160.0)
    missing = K.show_metrics(o1, "no_such_column").first()
    assert (missing.total, missing.highest) == (0.0, 0.0)
    axis = {r.axis_top for r in C.chart_category_revenue(o1).collect()}
    assert axis == {160.0 * 1.1}


def test_date_bounds(golden):
    b = L.filter_date_bounds(golden).first()
    assert (b.min_date, b.max_date) == (dt.date(2023, 12, 31), dt.date(2024, 2, 10))


def test_lookups_all_first(golden):
    assert [r.region for r in L.filter_regions(golden).collect()] == ["All", "East", "West"]
    assert [r.name for r in L.filter_warehouses(golden).collect()] == ["All", "Alpha", "Beta", "Delta", "Gamma"]
    assert [r.name for r in L.filter_categories(golden).collect()] == ["All", "Grocery", "Outdoor"]


def test_equal_groups_merge_and_units_add(spark):
    t = make_tables(
        spark,
        warehouse=[(1, "Solo", "L", "R", None)],
        product=[(2000, None, "Soap", Decimal("1.00"), None), (2001, None, "Soap", Decimal("1.00"), None)],
        inventory=[(1, 2000, 7, 3), (1, 2001, 7, 3)],
        salestransaction=[(1, None, 1, dt.datetime(2024, 1, 1), Decimal("5.00"))],
        salestransactionitem=[(1, 1, 2000, 2, None, Decimal("2.00")), (2, 1, 2001, 3, None, Decimal("3.00"))],
    )
    assert rows(R.promotion_candidates(t, Filters()), *PROMO_COLS) == [
        ("Solo", "Soap", 7, 3, 5, "Healthy Inventory")]


def test_rank_ties(spark):
    t = make_tables(
        spark,
        warehouse=[(1, "A", "L", "R", None), (2, "B", "L", "R", None), (3, "C", "L", "R", None)],
        salestransaction=[(1, None, 1, dt.datetime(2024, 1, 1), Decimal("10.00")),
                          (2, None, 2, dt.datetime(2024, 1, 1), Decimal("10.00")),
                          (3, None, 3, dt.datetime(2024, 1, 1), Decimal("5.00"))],
    )
    got = sorted(rows(R.warehouse_performance(t, Filters()), "warehouse_name", "regional_rank"))
    assert got == [("A", 1), ("B", 1), ("C", 3)]
