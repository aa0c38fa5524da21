"""Reports answered from sums by day, warehouse and category instead of from sale lines.

A dashboard asks the same reports under ever new filter tuples. All of O1, O2 and O4 are sums over a calendar day, a
warehouse and a category name, so a roll-up of that grain answers any filter tuple: its size is bounded by days x
warehouses x categories, whatever the number of sale lines. Batches of sales add their own sums
(``streaming.sources.Sums``: a delta per batch, a snapshot every 16), in any order.

Transaction counts add up because a transaction has one day and one warehouse. They would not add up over categories that share
a name under several department codes, where one transaction may hold both: ``first_transactions`` counts such a
transaction at the least of its codes only, so it adds up to the transactions of the *name*, while ``transactions``
adds up to those of a (name, code). ``receipt_cents`` is the whole amount of the transactions counted in ``first_transactions``.

A batch holds whole transactions: a transaction comes in one batch with all its items. Names of products and categories are those
known when the batch is added; warehouses are read when a report is asked for. NULL dates stay as the NULL day, which O2 counts and
O1 and O4 do not; NULL warehouses are in none of the three reports. Without any batch O1 and O4 are empty and O2 shows every warehouse with 0.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions import expressions as X
from shelfwise.functions.filters import Filters, equals_unless_all, where_all
from shelfwise.operators.reports import join_facts, ranked_warehouses, warehouses_in_scope, with_category
from shelfwise.session import scratch_path
from shelfwise.sources.catalog import RetailTables
from shelfwise.streaming.sources import Sums

CATEGORY_KEYS = ["day", "warehouseid", "category_name", "department_code"]
CATEGORY_SUMS = ("day date, warehouseid long, category_name string, department_code string, "
                 "cents long, units long, transactions long, first_transactions long, receipt_cents long")
RECEIPT_KEYS = ["day", "warehouseid"]
RECEIPT_SUMS = "day date, warehouseid long, receipt_cents long, transactions long"


def category_day(t: RetailTables) -> DataFrame:
    """Sums per day, warehouse, category name and department code of the tables' sales.

    Items and transactions meet on ``transactionid`` first; the two steps per transaction behind it keep that
    partitioning where the facts are stored in buckets of it.
    """
    tx = t.salestransaction.where("warehouseid IS NOT NULL").select(
        "transactionid", "warehouseid", F.col("transactiondate").cast("date").alias("day"), X.cents(F.col("totalamount")).alias("receipt"))
    items = t.salestransactionitem.select("transactionid", "productid", "quantity", "subtotal")
    sold = with_category(t, Filters(), join_facts(t, items, tx), "category_name", "department_code")
    per_receipt = sold.groupBy("transactionid", *CATEGORY_KEYS, "receipt").agg(
        F.sum(X.cents(F.col("subtotal"))).alias("cents"), F.sum("quantity").alias("units"))
    of_name = Window.partitionBy("transactionid", "category_name").orderBy("department_code")
    first = F.row_number().over(of_name) == 1
    marked = per_receipt.select("*", first.cast("long").alias("first"), F.when(first, F.col("receipt")).alias("first_receipt"))
    return marked.groupBy(*CATEGORY_KEYS).agg(
        F.sum("cents").alias("cents"), F.sum("units").cast("long").alias("units"), F.count(F.lit(1)).alias("transactions"),
        F.sum("first").alias("first_transactions"), F.sum("first_receipt").alias("receipt_cents"))


def receipt_day(t: RetailTables) -> DataFrame:
    """Amount and number of the transactions per day and warehouse."""
    tx = t.salestransaction.where("warehouseid IS NOT NULL")
    return tx.groupBy(F.col("transactiondate").cast("date").alias("day"), "warehouseid").agg(
        F.sum(X.cents(F.col("totalamount"))).alias("receipt_cents"), F.count("transactionid").alias("transactions"))


class SalesRollup:
    """The roll-up in a folder, and the reports over it."""

    def __init__(self, dims: RetailTables, folder: str):
        self.dims = dims
        self.categories = Sums(dims.spark, f"{folder}/category-day", CATEGORY_SUMS, CATEGORY_KEYS)
        self.receipts = Sums(dims.spark, f"{folder}/receipt-day", RECEIPT_SUMS, RECEIPT_KEYS)

    def add(self, batch: RetailTables, epoch: int) -> None:
        """Add the sales of a batch; repeating an epoch writes the same again."""
        self.categories.add(category_day(batch).select(*_names(CATEGORY_SUMS)), epoch)
        self.receipts.add(receipt_day(batch).select(*_names(RECEIPT_SUMS)), epoch)

    def _category_rows(self, f: Filters, days) -> DataFrame:
        rows = self.categories.read().where(days)
        return where_all(rows, equals_unless_all(F.col("category_name"), f.category))

    def category_revenue(self, f: Filters = Filters()) -> DataFrame:
        """O1, as ``reports.category_revenue``."""
        rows = self._category_rows(f, f.date_in_range(F.col("day"))).join(warehouses_in_scope(self.dims, f), "warehouseid", "left_semi")
        out = rows.groupBy("category_name", "department_code").agg(
            X.money(F.sum("cents")).alias("total_revenue"), F.sum("units").alias("total_units_sold"),
            F.sum("transactions").alias("transaction_count"))
        return out.orderBy(F.col("total_revenue").desc_nulls_first())

    def warehouse_performance(self, f: Filters = Filters()) -> DataFrame:
        """O2, as ``reports.warehouse_performance``, with and without a category."""
        kept = f.date_null_or_in_range(F.col("day"))
        if f.by_category:
            rows = self._category_rows(f, kept).withColumn("transactions", F.col("first_transactions")).where("first_transactions > 0")
        else:
            rows = self.receipts.read().where(kept)
        per_wh = rows.groupBy("warehouseid").agg(F.sum("receipt_cents").alias("kept_cents"), F.sum("transactions").alias("n_kept"))
        return ranked_warehouses(self.dims, f, per_wh, self.receipts.read())

    def warehouse_category(self, f: Filters = Filters()) -> DataFrame:
        """O4, as ``reports.warehouse_category``."""
        wh = warehouses_in_scope(self.dims, f, F.col("name").alias("warehouse_name"), "location", "region")
        rows = self._category_rows(f, f.date_in_range(F.col("day"))).join(wh, "warehouseid")
        out = rows.groupBy("warehouse_name", "location", "region", "category_name").agg(
            X.money(F.sum("cents")).alias("category_revenue"), F.sum("units").alias("units_sold"),
            F.sum("first_transactions").alias("transaction_count"))
        return out.orderBy(F.col("category_revenue").asc_nulls_last())


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: Batches that the registered run deals the sales into.
ARRIVALS = 3


def arriving_sales(t: RetailTables, folder: str | None = None, batches: int = ARRIVALS) -> SalesRollup:
    """A roll-up built from batches of whole transactions, dealt by hash of the transaction: every batch has sales of any day."""
    rollup = SalesRollup(t, folder or scratch_path(t.spark, "sales-rollup"))
    part = F.pmod(F.xxhash64("transactionid"), F.lit(batches))
    for epoch in range(batches):
        rollup.add(replace(t, salestransaction=t.salestransaction.where(part == epoch),
                           salestransactionitem=t.salestransactionitem.where(part == epoch)), epoch)
    return rollup
