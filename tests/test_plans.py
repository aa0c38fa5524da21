"""Plan checks: the shapes that matter at scale, read from ``explain``."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions.filters import Filters
from shelfwise.operators import reports as R
from shelfwise.plans.inspect import plan_text, pushed_filters, python_operators
from shelfwise.plans.registry import named_queries

NARROW = Filters(region="ASIA", warehouse="NATION_2", category="PROMO", start_date="1996-01-01",
                 end_date="1997-12-31")


@pytest.mark.parametrize("key", [k for k, q in named_queries().items() if q.run is not None])
def test_no_python_in_any_plan(small_tables, key):
    assert python_operators(named_queries()[key].run(small_tables)) == []


def test_date_range_reaches_the_scan(small_tables):
    filters = " ".join(pushed_filters(R.category_revenue(small_tables, NARROW)))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in filters
    assert "LessThan(o_orderdate,1998-01-01" in filters


def test_scan_reads_only_needed_columns(small_tables):
    text = plan_text(R.category_revenue(small_tables, Filters()))
    lineitem = [ln for ln in text.splitlines() if "ReadSchema: struct<l_orderkey" in ln]
    assert lineitem and all("l_shipdate" not in ln and "l_tax" not in ln for ln in lineitem)


def test_open_category_filter_plans_no_semi_join(small_tables):
    assert "LeftSemi" not in plan_text(R.warehouse_performance(small_tables, Filters()))
    assert "LeftSemi" in plan_text(R.warehouse_performance(small_tables, Filters(category="PROMO")))


def test_promotion_units_do_not_read_transactions(small_tables):
    # The original's date-filtered join to transactions changes nothing; it is left out.
    assert "orders.parquet" not in plan_text(R.promotion_candidates(small_tables, NARROW))


REPORTS = [R.category_revenue, R.warehouse_performance, R.low_inventory, R.warehouse_category, R.promotion_candidates]


@pytest.mark.parametrize("report", REPORTS)
@pytest.mark.parametrize("tables", ["golden", "small_tables"])
def test_reports_never_funnel_into_one_partition(request, tables, report):
    assert "SinglePartition" not in plan_text(report(request.getfixturevalue(tables), Filters()))


@pytest.mark.parametrize("f", [NARROW, Filters(category="PROMO", start_date="1996-01-01", end_date="1996-01-03"),
                               Filters(start_date="1996-01-01", end_date="1996-01-03")])
def test_dates_of_the_warehouse_report_reach_the_scan(small_tables, f):
    filters = " ".join(pushed_filters(R.warehouse_performance(small_tables, f)))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in filters


def test_inventory_is_read_once_by_the_low_stock_report(golden, monkeypatch):
    text = plan_text(R.low_inventory(golden, Filters()), "simple")
    assert text.count("stockquantity#") and "LeftAnti" not in text and "Union" not in text


def test_fact_is_shuffled_once_in_category_revenue(golden):
    text = plan_text(R.category_revenue(golden, Filters()), "simple")
    # item⋈transaction on the key, the small final aggregate, the final sort.
    assert text.count("Exchange hashpartitioning(transactionid") <= 2


def test_bucketed_facts_save_the_transaction_shuffle(spark, small_tables, tmp_path):
    """With bucketed facts and no broadcast allowed at all, neither side of the fact join is exchanged,
    and product joins what is left of the items."""
    from shelfwise.sources.catalog import store_tables
    stored = store_tables(small_tables, str(tmp_path / "tables"), files_per_table=2, fact_buckets=4,
                          table_prefix="plancheck_")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (R.category_revenue, R.warehouse_category):
            for f in (Filters(), Filters(category="PROMO", start_date="1996-01-01", end_date="1997-12-31")):
                text = plan_text(report(stored, f), "simple")
                assert "SortMergeJoin [transactionid" in text
                assert "Bucketed: true" in text
                assert "Exchange hashpartitioning(transactionid" not in text.split("SortMergeJoin [transactionid")[1]
        unbucketed = plan_text(R.category_revenue(small_tables, Filters()), "simple")
        assert unbucketed.count("Exchange hashpartitioning(transactionid") == 2
        # and the result is unchanged by the storage form
        a = sorted(map(tuple, R.category_revenue(stored, Filters()).collect()))
        b = sorted(map(tuple, R.category_revenue(small_tables, Filters()).collect()))
        assert a == b
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_positions_are_numbered_by_range(spark):
    """A group that holds nearly all rows is numbered in many tasks, NULL groups included, equal to one window."""
    rows = spark.range(4000).selectExpr("id % 997 AS v", "CASE WHEN id % 100 = 0 THEN NULL WHEN id % 50 = 0 THEN 'b' ELSE 'a' END AS g", "id")
    keys = [F.col("v").desc_nulls_last(), F.col("id").asc_nulls_last()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.positions(rows, "g", keys)
        want = rows.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*keys)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "windowspecdefinition(_range" in plan_text(got, "extended")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_summed_chart_does_not_sort_its_rows(small_tables):
    assert "rangepartitioning" not in plan_text(named_queries()["chart_stock_vs_reorder"].run(small_tables), "simple")


def test_positions_shuffle_their_rows_once(spark):
    """Behind the ranges only counts are shuffled: no rows go to a window."""
    rows = spark.range(3000).selectExpr("id % 7 AS v", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('g', id % 40) END AS g", "id")
    keys = [F.col("v").asc_nulls_last(), F.col("id").desc_nulls_last()]
    got = R.positions(rows, "g", keys)
    want = rows.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*keys)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = plan_text(got, "simple")
    assert "row_number" not in text
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_facts_are_dealt_by_their_rows(small_tables, spark, monkeypatch):
    """A join of facts plans tasks by the number of items, more than the session has shuffle partitions; the rows are the same."""
    from shelfwise import session
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(tuple, R.warehouse_category(small_tables, Filters()).collect()))
        monkeypatch.setattr(session, "TASK_ROWS", 50)
        tasks = small_tables.salestransactionitem.count() // 50
        assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = R.warehouse_category(small_tables, Filters())
        assert plan_text(got, "simple").count(f", {tasks}), REPARTITION_BY_NUM") == 2
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
