"""Reports over lines stored by date equal the direct reports, and read only what their range needs."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_rollup import _random_filters, _random_sales, _rows

from shelfwise.functions.filters import Filters
from shelfwise.operators import reports as R
from shelfwise.plans.inspect import plan_text
from shelfwise.sources.sale_lines import MONTH, store_sale_lines, with_sale_lines

REPORTS = (R.category_revenue, R.warehouse_category, R.promotion_candidates_scoped)


@pytest.mark.parametrize("seed", [1])
def test_reports_equal_the_direct_ones(spark, tmp_path, seed):
    t = _random_sales(spark, seed)
    t = replace(t, inventory=spark.range(48).selectExpr("id % 8 AS warehouseid", "id div 6 AS productid",
                                                        "cast(id AS int) AS stockquantity", "cast(5 AS int) AS reorderlevel"))
    stored = store_sale_lines(t, str(tmp_path / "lines"), files=3)
    rng = random.Random(200 + seed)
    for f in [Filters(), Filters(category="Food"), *(_random_filters(rng) for _ in range(3))]:
        for report in REPORTS:
            assert _rows(report(stored, f)) == _rows(report(t, f)), (report.__name__, f)


def test_batches_append(spark, tmp_path):
    t, path = _random_sales(spark, 5), str(tmp_path / "lines")
    for part in (1, 0):
        batch = replace(t, salestransaction=t.salestransaction.where(F.col("transactionid") % 2 == part))
        store_sale_lines(batch, path, append=part == 0)
    f = Filters(start_date="2024-02-03", end_date="2024-03-31")
    assert _rows(R.category_revenue(with_sale_lines(t, path), f)) == _rows(R.category_revenue(t, f))


def test_without_sales(spark, tmp_path):
    t = _random_sales(spark, 1, n=0)
    stored = store_sale_lines(t, str(tmp_path / "lines"))
    assert R.category_revenue(stored).count() == R.warehouse_category(stored).count() == 0


def _scanned(df, column):
    """Partitions, files and rows that the scans with ``column`` in their schema read, from the run plan's own metrics."""
    df.collect()
    leaves, out = df._jdf.queryExecution().executedPlan().collectLeaves(), {}
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if column in leaf.schema().simpleString():
            for name in ("numPartitions", "numFiles", "numOutputRows"):
                out[name] = out.get(name, 0) + leaf.metrics().apply(name).value()
    return out


def test_rows_read_fall_with_the_range(spark, small_tables, tmp_path):
    stored = store_sale_lines(small_tables, str(tmp_path / "lines"), files=4)
    total = stored.sale_lines.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        year = Filters(start_date="1996-01-01", end_date="1996-12-31")
        days = Filters(start_date="1996-01-01", end_date="1996-01-03")
        read = [_scanned(R.category_revenue(stored, f), MONTH) for f in (Filters(), year, days)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    months = stored.sale_lines.where(f"{MONTH} IS NOT NULL").select(MONTH).distinct().count()
    assert [r["numPartitions"] for r in read] == [months, 12, 1]
    assert read[0]["numOutputRows"] <= total and read[1]["numOutputRows"] < total / 4 and read[2]["numOutputRows"] < total / 40


def test_facts_are_not_joined(small_tables, spark, tmp_path):
    stored = store_sale_lines(small_tables, str(tmp_path / "lines"), files=2)
    f = Filters(start_date=dt.date(1996, 1, 1), end_date=dt.date(1996, 1, 31))
    for report in REPORTS:
        text = plan_text(report(stored, f))
        assert "orders.parquet" not in text and "l_orderkey" not in text  # lineitem is read for the supply pairs alone
        assert "GreaterThanOrEqual(transactiondate,1996-01-01" in text


def test_a_hot_day_is_written_by_many_tasks(spark, tmp_path):
    t = _random_sales(spark, 4, n=0)
    n = 4000
    sales = spark.range(n).selectExpr("id AS transactionid", "cast(NULL AS long) AS memberid", "id % 8 AS warehouseid",
                                      "timestamp'2024-01-05 10:00:00' AS transactiondate", "cast(1 AS decimal(12,2)) AS totalamount")
    items = spark.range(n).selectExpr("id AS itemid", "id AS transactionid", "id % 8 AS productid", "1 AS quantity",
                                      "cast(1 AS decimal(12,2)) AS unitprice", "cast(1 AS decimal(12,2)) AS subtotal")
    stored = store_sale_lines(replace(t, salestransaction=sales, salestransactionitem=items), str(tmp_path / "lines"), files=8)
    sizes = [r[1] for r in stored.sale_lines.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < n / 4
