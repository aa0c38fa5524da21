"""Relations between operators that must hold on any data (checked on sf0.001)."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import SMALL_SF, make_tables
from pyspark.sql import functions as F

from shelfwise.functions.filters import Filters
from shelfwise.operators import reports as R
from shelfwise.operators import rules as P
from shelfwise.operators import series as C

RANGE = Filters(start_date="1996-01-01", end_date="1997-12-31")


def _total(df, col):
    return df.agg(F.sum(F.col(col).cast("decimal(38,2)"))).first()[0]


@pytest.mark.parametrize("f", [Filters(), RANGE, Filters(region="ASIA")])
def test_warehouse_category_sums_to_category_revenue(small_tables, f):
    assert _total(R.warehouse_category(small_tables, f), "category_revenue") == \
        _total(R.category_revenue(small_tables, f), "total_revenue")


def test_promotion_ignores_date_range(small_tables):
    a = R.promotion_candidates(small_tables, Filters()).collect()
    b = R.promotion_candidates(small_tables, Filters(start_date="2000-01-01", end_date="2000-01-02")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_narrower_dates_never_add_a_warehouse(small_tables):
    wide = {r.warehouseid for r in R.warehouse_performance(small_tables, Filters()).collect()}
    narrow = {r.warehouseid for r in R.warehouse_performance(
        small_tables, Filters(start_date="1996-01-01", end_date="1996-01-03")).collect()}
    assert narrow <= wide


def test_shares_sum_to_one(small_tables):
    shares = C.revenue_share(R.category_revenue(small_tables, Filters()))
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_low_inventory_never_healthy(small_tables):
    statuses = {r[0] for r in R.low_inventory(small_tables, Filters()).select("inventory_status").distinct().collect()}
    assert statuses <= {"Out of Stock", "Restock Now", "Monitor Closely"}


def test_tables_are_whole(spark, small_tables):
    raw = spark.read.parquet(f"{SMALL_SF}/lineitem.parquet")
    assert small_tables.salestransactionitem.count() == raw.count()
    pairs = raw.select("l_partkey", "l_suppkey").distinct()
    assert small_tables.productsupplier.count() == pairs.count()
    nations = spark.read.parquet(f"{SMALL_SF}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    assert small_tables.inventory.count() == pairs.join(nations, "l_suppkey").select("l_partkey", "s_nationkey").distinct().count()
    assert small_tables.category.select("categoryid").distinct().count() == small_tables.category.count()


def test_worst_pairs_without_a_number_are_all_pairs(small_tables):
    everything = P.rule_worst_pairs(small_tables).collect()
    assert len(everything) == R.warehouse_category(small_tables, Filters()).count()
    assert everything[:3] == P.rule_worst_pairs(small_tables, 3).collect()


def test_suppliers_with_and_without_match(spark, golden):
    rows = spark.createDataFrame([(1000, "a"), (1002, "b"), (None, "c")], "productid long, x string")
    got = R.with_suppliers(golden, rows, F.col("name").alias("supplier_name")).select("productid", "x", "supplier_name")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1000, "a", "S-One"), (1000, "a", "S-Two"), (1002, "b", None), (None, "c", None)], key=str)


@pytest.mark.parametrize("seed", range(12))
def test_warehouse_performance_equals_the_plain_left_join(spark, seed):
    """Random sales with NULL dates, NULL warehouses and warehouses that fall out of the range."""
    rng = random.Random(seed)
    sites = [(i, f"W{i}", "L", rng.choice("AB"), None) for i in range(8)]
    sales = [(k, None, rng.choice([None, *range(7)]), rng.choice([None, dt.datetime(2024, rng.randint(1, 4), rng.randint(1, 28))]),
              Decimal(rng.randint(1, 999)) / 100) for k in range(rng.randint(0, 25))]
    t = make_tables(spark, warehouse=sites, salestransaction=sales)
    f = Filters(start_date="2024-02-01", end_date="2024-02-29")
    joined = t.warehouse.join(t.salestransaction, "warehouseid", "left") \
        .where("transactiondate IS NULL OR to_date(transactiondate) BETWEEN '2024-02-01' AND '2024-02-29'") \
        .groupBy("warehouseid").agg(F.coalesce(F.sum("totalamount"), F.lit(0)).cast("double").alias("m"), F.count("transactionid").alias("n"))
    got = R.warehouse_performance(t, f).select("warehouseid", "total_revenue", "transaction_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))
