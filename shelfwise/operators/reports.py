"""The five business reports, each a function ``(tables, filters) -> DataFrame``.

The semantics keep the original reports' quirks (listed per report); output column
names are fixed values of those reports.  The plans are written so that the one large shuffle of each report is the
fact join or a pre-aggregated fact, and the dimensions are joined by size (small
ones are broadcast by the optimizer's size check, large ones sort-merge joined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import expressions as X
from shelfwise.functions.filters import Filters, equals_unless_all, where_all
from shelfwise.session import dealt, scratch_path
from shelfwise.sources.catalog import FACT_BUCKET_KEY, RetailTables
from shelfwise.sources.sale_lines import in_range as sale_lines_in_range


# ---------------------------------------------------------------------------
# Shared pieces
# ---------------------------------------------------------------------------

def warehouses_in_scope(t: RetailTables, f: Filters, *cols: str) -> DataFrame:
    """Warehouses passing the region and warehouse-name filters."""
    w = t.warehouse
    return where_all(w, equals_unless_all(w.region, f.region),
                     equals_unless_all(w["name"], f.warehouse)).select("warehouseid", *cols)


def categories_in_scope(t: RetailTables, f: Filters) -> DataFrame:
    c = t.category
    return where_all(c, equals_unless_all(c["name"], f.category)).select(
        "categoryid", F.col("name").alias("category_name"), F.col("deptcode").alias("department_code"))


def products_in_scope(t: RetailTables, f: Filters, *cols: str) -> DataFrame:
    """Products, with a category filter only those of the category."""
    p = t.product.select("productid", "categoryid", *cols)
    return p.join(categories_in_scope(t, f).select("categoryid"), "categoryid", "left_semi") if f.by_category else p


def transactions_in_scope(t: RetailTables, f: Filters, keep, *cols: str) -> DataFrame:
    """Transactions that pass the date condition and belong to a warehouse in scope, before any join of facts."""
    tx = t.salestransaction.where(F.col("warehouseid").isNotNull() & keep).select("transactionid", "warehouseid", *cols)
    return _of_warehouses_in_scope(t, f, tx)


def _of_warehouses_in_scope(t: RetailTables, f: Filters, rows: DataFrame) -> DataFrame:
    return rows.join(warehouses_in_scope(t, f), "warehouseid", "left_semi") if f.by_region or f.by_warehouse else rows


def lines_in_scope(t: RetailTables, f: Filters, *cols: str) -> DataFrame:
    """Sale lines of in-scope transactions that have a date in the range, with ``transactionid`` and ``warehouseid``.

    Lines stored with their date are read by the range alone; otherwise items meet the transactions that are left.
    """
    if t.sale_lines is not None:
        lines = t.sale_lines.where(F.col("warehouseid").isNotNull() & sale_lines_in_range(f))
        return _of_warehouses_in_scope(t, f, lines.select("transactionid", "warehouseid", *cols))
    items = t.salestransactionitem.select("transactionid", *cols)
    return join_facts(t, items, transactions_in_scope(t, f, f.date_in_range(F.col("transactiondate"))))


def join_facts(t: RetailTables, items: DataFrame, transactions: DataFrame) -> DataFrame:
    """Items with their transactions. Both are dealt by the number of items first, unless they are stored in buckets of the key."""
    if t.facts_bucketed:
        return items.join(transactions, FACT_BUCKET_KEY)
    n = t.salestransactionitem.count()
    return dealt(items, n, FACT_BUCKET_KEY).join(dealt(transactions, n, FACT_BUCKET_KEY), FACT_BUCKET_KEY)


def with_category(t: RetailTables, f: Filters, rows: DataFrame, *cat_cols: str) -> DataFrame:
    """Rows carrying ``productid`` joined (inner) to product and then to its category.

    The two joins are kept apart on purpose: without column statistics the
    optimizer estimates a join's size as the product of its inputs, so a
    pre-joined product-category dimension would look huge and never pass the
    broadcast size check; the plain product and category scans do (and fall
    back to a sort-merge join when they really are large).
    """
    rows = rows.join(products_in_scope(t, f), "productid")
    cats = categories_in_scope(t, f).select("categoryid", *cat_cols)
    return rows.join(cats, "categoryid").drop("categoryid")


def sold_items(t: RetailTables, f: Filters, cat_cols: tuple, wh_cols: tuple) -> DataFrame:
    """Items of in-scope transactions, with their category and warehouse attributes.

    The facts meet first, on ``transactionid``: date, region and warehouse have cut the
    transactions before, and tables stored in buckets of that key need no exchange. Lines stored
    with their date need no such join.
    Product, category and warehouse follow on the rows that are left. The inner
    joins drop transactions with a NULL or unknown warehouse and items whose category
    is unknown; the date test drops NULL dates even when the range is open.
    """
    sold = lines_in_scope(t, f, "productid", "quantity", "subtotal")
    return with_category(t, f, sold, *cat_cols).join(warehouses_in_scope(t, f, *wh_cols), "warehouseid")


# ---------------------------------------------------------------------------
# O1 category revenue
# ---------------------------------------------------------------------------

def category_revenue(t: RetailTables, f: Filters = Filters(), exact: bool = False) -> DataFrame:
    """Revenue, units and distinct transactions per (category name, department code).

    Quirks kept: grouped by name and code, not id; NULL-warehouse and NULL-date sales
    are dropped even with open filters; the whole last day of the range counts.
    With ``exact``, revenue stays a decimal for further sums.
    """
    sold = sold_items(t, f, ("category_name", "department_code"), ())
    out = sold.groupBy("category_name", "department_code").agg(
        X.money(F.sum(X.cents(F.col("subtotal"))), exact).alias("total_revenue"),
        F.sum("quantity").cast("long").alias("total_units_sold"),
        F.countDistinct("transactionid").alias("transaction_count"),
    )
    return out.orderBy(F.col("total_revenue").desc_nulls_first())


# ---------------------------------------------------------------------------
# O2 warehouse performance
# ---------------------------------------------------------------------------

def warehouse_performance(t: RetailTables, f: Filters = Filters(), exact: bool = False) -> DataFrame:
    """Revenue, transaction count and regional rank per warehouse.

    A warehouse without any transaction stays with 0, one whose transactions all fall
    outside the date range disappears, NULL dates count.  With a category chosen, only
    transactions holding an item of it count, with their *whole* amount, and
    warehouses without such transactions disappear.

    Date, region and warehouse cut the transactions at the scan; the rest is aggregated per
    warehouse (one row per warehouse and task crosses the shuffle) before it meets the
    warehouses.  Which warehouses have transactions outside the range needs only
    the distinct warehouse ids.
    """
    st = transactions_in_scope(t, f, f.date_null_or_in_range(F.col("transactiondate")), "totalamount")
    if f.by_category:
        in_category = t.salestransactionitem.select("transactionid", "productid").join(
            products_in_scope(t, f).select("productid"), "productid", "left_semi")
        st = st.join(in_category.select("transactionid"), "transactionid", "left_semi")
    per_wh = st.groupBy("warehouseid").agg(
        F.sum(X.cents(F.col("totalamount"))).alias("kept_cents"), F.count("transactionid").alias("n_kept"))
    return ranked_warehouses(t, f, per_wh, t.salestransaction.where(F.col("warehouseid").isNotNull()), exact)


def ranked_warehouses(t: RetailTables, f: Filters, per_wh: DataFrame, sales: DataFrame, exact: bool = False) -> DataFrame:
    """O2's rows from ``kept_cents`` and ``n_kept`` per warehouse; ``sales`` holds the warehouses that have transactions at all."""
    wh = warehouses_in_scope(t, f, "name", "location", "region")
    if f.by_category:
        joined = wh.join(per_wh, "warehouseid")
    else:
        joined = wh.join(per_wh, "warehouseid", "left")
        if not f.open_dates:
            seen = sales.select("warehouseid").distinct()
            joined = joined.join(seen.withColumn("seen", F.lit(True)), "warehouseid", "left") \
                .where(F.col("n_kept").isNotNull() | F.col("seen").isNull())
    revenue = F.coalesce(F.col("kept_cents"), F.lit(0).cast("long"))
    ranked = joined.select(
        "warehouseid",
        F.col("name").alias("warehouse_name"),
        "location",
        "region",
        X.money(revenue, exact).alias("total_revenue"),
        F.coalesce(F.col("n_kept"), F.lit(0)).cast("long").alias("transaction_count"),
        F.rank().over(Window.partitionBy("region").orderBy(revenue.desc())).alias("regional_rank"),
    )
    return ranked.orderBy(F.col("total_revenue").desc_nulls_first())


# ---------------------------------------------------------------------------
# O3 low inventory
# ---------------------------------------------------------------------------

def stock_rows(t: RetailTables, f: Filters, condition, require_category: bool = True) -> DataFrame:
    """Inventory rows meeting ``condition(stock, reorder)``, with warehouse and product
    names; filtered before any join, so the fan-out below starts from few rows."""
    inv = t.inventory
    inv = inv.where(condition(inv.stockquantity, inv.reorderlevel))
    inv = inv.join(warehouses_in_scope(t, f, F.col("name").alias("warehouse_name")), "warehouseid")
    inv = inv.join(t.product.select("productid", "categoryid", F.col("name").alias("product_name")), "productid")
    if require_category:
        inv = inv.join(categories_in_scope(t, f).select("categoryid"), "categoryid")
    return inv.drop("categoryid")


def with_suppliers(t: RetailTables, rows: DataFrame, *supplier_cols) -> DataFrame:
    """One row per supplier of each row's product (kept once, with NULLs, if none).

    Supplier meets the supply relation first, so the rows are joined once and a missing supplier
    is never a join key.  The relation's key is (product, supplier), which bounds the fan-out.
    """
    ps = t.productsupplier.select("productid", "supplierid", "leadtimedays")
    supplied = ps.join(t.supplier.select("supplierid", *supplier_cols), "supplierid", "left")
    return rows.join(supplied, "productid", "left")


def low_inventory(t: RetailTables, f: Filters = Filters(), ordered: bool = True) -> DataFrame:
    """Stock at or near the reorder level, one row per supplier of the product.

    No date filter applies.  Products without a category are dropped (inner join),
    products without a supplier stay with NULLs; NULL stock or reorder level drops
    the row.  Sorted by urgency, then lead time descending with NULLs last.
    """
    rows = stock_rows(t, f, X.near_reorder)
    out = with_suppliers(t, rows, F.col("name").alias("supplier_name")).select(
        "warehouse_name", "product_name", "stockquantity", "reorderlevel", "leadtimedays", "supplier_name",
        X.inventory_status(F.col("stockquantity"), F.col("reorderlevel")).alias("inventory_status"),
    )
    if not ordered:
        return out
    return out.orderBy(X.urgency(F.col("stockquantity"), F.col("reorderlevel")),
                       F.col("leadtimedays").desc_nulls_last())


# ---------------------------------------------------------------------------
# O4 warehouse x category revenue
# ---------------------------------------------------------------------------

def warehouse_category(t: RetailTables, f: Filters = Filters(), exact: bool = False) -> DataFrame:
    """Revenue per (warehouse name, location, region, category name), worst first."""
    sold = sold_items(t, f, ("category_name",), (F.col("name").alias("warehouse_name"), "location", "region"))
    out = sold.groupBy("warehouse_name", "location", "region", "category_name").agg(
        X.money(F.sum(X.cents(F.col("subtotal"))), exact).alias("category_revenue"),
        F.sum("quantity").cast("long").alias("units_sold"),
        F.countDistinct("transactionid").alias("transaction_count"),
    )
    return out.orderBy(F.col("category_revenue").asc_nulls_last())


# ---------------------------------------------------------------------------
# O5 promotion candidates (as written) and O5b (scoped units)
# ---------------------------------------------------------------------------

def _inventory_for_promotion(t: RetailTables, f: Filters) -> DataFrame:
    """Inventory rows with warehouse and product, after region/warehouse/category filters.

    The category test is ``categoryid IN (ids named so)``: a semi-join, so products
    without a category stay when no category is chosen.
    """
    inv = t.inventory.join(warehouses_in_scope(t, f, F.col("name").alias("warehouse_name")), "warehouseid")
    prod = products_in_scope(t, f, F.col("name").alias("product_name"), "product_details")
    return inv.join(prod.drop("categoryid"), "productid")


def _promotion_groups(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("warehouse_name", "product_name", "stockquantity", "reorderlevel",
                           "product_details").agg(
        F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units_sold"))
    out = grouped.select(
        "warehouse_name", "product_name", "stockquantity", "reorderlevel", "units_sold",
        X.promotion_recommendation(F.col("stockquantity"), F.col("reorderlevel"), F.col("units_sold"),
                                   F.col("product_details")).alias("promotion_recommendation"),
    )
    return out.orderBy(F.col("stockquantity").desc_nulls_first())


def items_in_scope(t: RetailTables, f: Filters) -> DataFrame:
    """Items, with a category filter only those of its products."""
    items = t.salestransactionitem.select("productid", "quantity")
    return items.join(products_in_scope(t, f).select("productid"), "productid", "left_semi") if f.by_category else items


def units_by_product(t: RetailTables, f: Filters = Filters()) -> DataFrame:
    """All-time, all-warehouse units per product: one pre-aggregated shuffle."""
    return items_in_scope(t, f).groupBy("productid").agg(F.sum("quantity").alias("units"))


def promotion_candidates(t: RetailTables, f: Filters = Filters()) -> DataFrame:
    """Promotion advice per inventory group, exactly as the original report computes it.

    Units sold ignore the date range and the warehouse: items are joined on the
    product only, and the date test sits in a further LEFT JOIN whose columns are
    never used.  Inventory rows equal in warehouse name, product name, stock,
    reorder level and details merge and their units add up.

    The original multiplies each inventory row by all items of its product; here
    the items are summed per product first and the sums summed per group, which is
    equal because addition is associative and each item belongs to one transaction.
    """
    rows = _inventory_for_promotion(t, f).join(units_by_product(t, f), "productid", "left")
    return _promotion_groups(rows)


def promotion_candidates_scoped(t: RetailTables, f: Filters = Filters()) -> DataFrame:
    """O5 with units counted in the inventory row's own warehouse and the date range."""
    sold = lines_in_scope(t, f, "productid", "quantity")
    if f.by_category:
        sold = sold.join(products_in_scope(t, f).select("productid"), "productid", "left_semi")
    units = sold.groupBy("warehouseid", "productid").agg(F.sum("quantity").alias("units"))
    rows = _inventory_for_promotion(t, f).join(units, ["warehouseid", "productid"], "left")
    return _promotion_groups(rows)


# ---------------------------------------------------------------------------
# Order as a column
# ---------------------------------------------------------------------------

def positions(rows: DataFrame, group: str, keys: list[Column], name: str = "position") -> DataFrame:
    """Each row's place in the list of its ``group``, by a sort that is dealt over ranges and not over groups.

    Rows are range-partitioned by group and keys, sorted in their range and written with their place in it. A group's rows in one
    range stand side by side, behind those of the groups before it there; what lower ranges hold of the group is added. Both come
    from counts of which there are at most ranges plus groups. So a group that holds a third of all rows fills a third of the
    ranges, and rows are shuffled and sorted once.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "positions")
    by = [F.col(group).asc_nulls_first(), *keys]
    # the range's number, above 33 bits of the place in it
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType())])).parquet(path)
    of_range = F.shiftright("_at", 33)
    counts = dealt.groupBy(F.col(group).alias("_group"), of_range.alias("_range")).agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_range").orderBy(F.col("_group").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(lower), F.lit(0)) - F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    before = counts.select("_group", "_range", shift.alias("_shift"))
    place = F.col("_at") - F.shiftleft("_range", 33) + F.col("_shift") + 1
    return dealt.join(F.broadcast(before), (of_range == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group"))) \
        .select(*rows.columns, place.cast("int").alias(name))


def low_inventory_ordered(t: RetailTables, f: Filters = Filters()) -> DataFrame:
    """The low-stock list with each row's position in its warehouse's list, ties broken by all columns."""
    rows = low_inventory(t, f, ordered=False).drop("inventory_status")  # derived again behind the sort, which need not carry it
    order = [X.urgency(F.col("stockquantity"), F.col("reorderlevel")), F.col("leadtimedays").desc_nulls_last()]
    ties = [F.col(c).asc_nulls_last() for c in ("product_name", "supplier_name", "stockquantity", "reorderlevel")]
    placed = positions(rows, "warehouse_name", order + ties)
    return placed.select(*rows.columns, X.inventory_status(F.col("stockquantity"), F.col("reorderlevel")).alias("inventory_status"), "position")


def warehouse_category_bottom(t: RetailTables, f: Filters = Filters(), n: int = 10) -> DataFrame:
    """The ``n`` weakest warehouse × category rows with their position: numbered after a distributed top-k."""
    keys = [F.col(c).asc_nulls_last() for c in ("category_revenue", "warehouse_name", "category_name", "location", "region")]
    low = warehouse_category(t, f).orderBy(*keys).limit(n)
    return low.withColumn("position", F.row_number().over(Window.orderBy(*keys)))
