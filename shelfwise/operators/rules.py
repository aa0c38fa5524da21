"""The copilot's business rules, as deterministic operators.

The original hands these rules to a language model that writes SQL; here each
rule is an operator of its own.  ``order="worst"`` gives the ascending order the
rules prescribe for 'underperforming', 'worst' or 'low'.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import expressions as X
from shelfwise.functions.filters import Filters
from shelfwise.operators.reports import stock_rows, units_by_product, with_category, with_suppliers
from shelfwise.sources.catalog import RetailTables

# Fixed value: the words that ask for ascending order.
WORST_WORDS = ("underperforming", "worst", "low")


def order_for(question: str) -> str:
    """'worst' when the question uses one of the words above, else 'best'."""
    return "worst" if set(re.findall(r"[a-z]+", question.lower())) & set(WORST_WORDS) else "best"


def _by(col: str, order: str, *ties: str):
    c = F.col(col)
    key = c.asc_nulls_last() if order == "worst" else c.desc_nulls_first()
    return [key] + [F.col(t).asc_nulls_last() for t in ties]


def _check_order(order: str) -> None:
    if order not in ("best", "worst"):
        raise ValueError("order must be 'best' or 'worst'")


def rule_category_revenue(t: RetailTables, order: str = "best") -> DataFrame:
    """SUM(subtotal) per category name: every sale, any date, any warehouse."""
    _check_order(order)
    per_product = t.salestransactionitem.groupBy("productid").agg(F.sum(X.cents(F.col("subtotal"))).alias("c"))
    out = with_category(t, Filters(), per_product, "category_name").groupBy("category_name").agg(
        X.money(F.sum("c")).alias("total_revenue"))
    return out.orderBy(*_by("total_revenue", order, "category_name"))


def rule_warehouse_sales(t: RetailTables, order: str = "best") -> DataFrame:
    """SUM(totalamount) per warehouse name (transactions without a warehouse drop out).

    Transactions are summed per warehouse id first, so one row per warehouse meets
    the warehouse table, then summed again per name.
    """
    _check_order(order)
    per_id = (t.salestransaction.where(F.col("warehouseid").isNotNull())
              .groupBy("warehouseid").agg(F.sum(X.cents(F.col("totalamount"))).alias("c")))
    named = per_id.join(t.warehouse.select("warehouseid", F.col("name").alias("warehouse_name")), "warehouseid")
    out = named.groupBy("warehouse_name").agg(X.money(F.sum("c")).alias("total_sales"))
    return out.orderBy(*_by("total_sales", order, "warehouse_name"))


def rule_reorder_contacts(t: RetailTables) -> DataFrame:
    """Stock strictly under the reorder level, with each supplier's contact data."""
    rows = stock_rows(t, Filters(), lambda stock, reorder: stock < reorder, require_category=False)
    out = with_suppliers(t, rows, F.col("name").alias("supplier_name"), "contactperson", "email", "phone")
    return out.select("warehouse_name", "product_name", "stockquantity", "reorderlevel", "leadtimedays",
                      "supplier_name", "contactperson", "email", "phone")


def rule_worst_pairs(t: RetailTables, n: int | None = None) -> DataFrame:
    """Warehouse/category pairs by SUM(subtotal), lowest first, any date; with ``n`` only the lowest ``n``.

    Items meet their transactions first and are summed per (warehouse, product), so names and categories
    are attached to sums.  A bottom-n runs as a distributed take-ordered.
    """
    tx = t.salestransaction.where(F.col("warehouseid").isNotNull()).select("transactionid", "warehouseid")
    sums = t.salestransactionitem.select("transactionid", "productid", "subtotal").join(tx, "transactionid") \
        .groupBy("warehouseid", "productid").agg(F.sum(X.cents(F.col("subtotal"))).alias("c"))
    named = with_category(t, Filters(), sums, "category_name").join(
        t.warehouse.select("warehouseid", F.col("name").alias("warehouse_name")), "warehouseid")
    pairs = named.groupBy("warehouse_name", "category_name").agg(X.money(F.sum("c")).alias("category_revenue"))
    pairs = pairs.orderBy(*_by("category_revenue", "worst", "warehouse_name", "category_name"))
    return pairs if n is None else pairs.limit(n)


def trapped_capital(t: RetailTables, f: Filters = Filters()) -> DataFrame:
    """Slow movers: company-wide units sold < 5 % of the row's stock; capital = stock × price.

    One row per inventory row (warehouse, product); units are all-warehouse, as in the promotion report, and all-time
    unless ``f`` has dates: then only units of those days count, so it names what has not sold lately.
    """
    inv = t.inventory.select("warehouseid", "productid", "stockquantity")
    inv = inv.join(t.warehouse.select("warehouseid", F.col("name").alias("warehouse_name")), "warehouseid")
    inv = inv.join(t.product.select("productid", F.col("name").alias("product_name"), "price"), "productid")
    if f.open_dates:
        sold = units_by_product(t)
    else:
        days = t.salestransaction.where(f.date_in_range(F.col("transactiondate"))).select("transactionid")
        sold = t.salestransactionitem.select("transactionid", "productid", "quantity").join(days, "transactionid") \
            .groupBy("productid").agg(F.sum("quantity").alias("units"))
    rows = inv.join(sold, "productid", "left")
    units = F.coalesce(F.col("units"), F.lit(0)).cast("long")
    slow = units < F.col("stockquantity") * F.lit(X.SLOW_MOVER_RATIO)
    out = rows.where(slow).select(
        "warehouseid", "productid", "warehouse_name", "product_name", "stockquantity",
        units.alias("units_sold"),
        F.col("price").cast(X.MONEY_OUT).alias("price"),
        (F.col("stockquantity") * F.col("price")).cast(X.MONEY_OUT).alias("trapped_capital"),
    )
    return out.orderBy(F.col("trapped_capital").desc_nulls_first())


def search_warehouses(t: RetailTables, text: str) -> DataFrame:
    """Warehouses whose name contains ``text``, case-insensitively (taken literally)."""
    w = t.warehouse
    return w.where(X.contains_ci(w["name"], text)).select("warehouseid", "name", "location", "region")


def search_products(t: RetailTables, text: str) -> DataFrame:
    p = t.product
    return p.where(X.contains_ci(p["name"], text)).select(
        "productid", "name", "categoryid", F.col("price").cast(X.MONEY_OUT).alias("price"))
