"""Key figures and one-sentence insights over a report's result.

Each takes the (lazy) report DataFrame and adds one aggregation on top of it, so
the figures are computed where the report is, and only one row comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import expressions as X

# ---------------------------------------------------------------------------
# Texts of the dashboard's insight lines.
# ---------------------------------------------------------------------------
NO_RECORDS = "No records found for the selected filters."
SOLE_CONTRIBUTOR = "Business insight: At this filtered level, %s is the sole contributor with a value of %s."
STRONGEST_WEAKEST = ("Business insight: %s is the strongest %s in this view (%s), "
                     "while %s is the weakest (%s).")
WEAKEST_PAIR = "Business insight: %s / %s is the lowest-performing combination in this view (%s)."


def exact_sum(df: DataFrame, col: str) -> Column:
    """Sum of a result column as DOUBLE: decimals are summed exactly and cast once, other numbers as they are."""
    return F.sum(col).cast("double")


def show_metrics(df: DataFrame, metric_col: str) -> DataFrame:
    """Rows, total and highest of one column; zeros when empty or the column is absent."""
    if metric_col not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(0.0).alias("total"), F.lit(0.0).alias("highest"))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(exact_sum(df, metric_col), F.lit(0.0)).alias("total"),
        F.coalesce(F.max(metric_col).cast("double"), F.lit(0.0)).alias("highest"),
    )


def low_inventory_metrics(df: DataFrame) -> DataFrame:
    """Alerted rows (supplier fan-out included), 'Restock Now' and 'Out of Stock' rows."""
    status = F.col("inventory_status")
    return df.agg(
        F.count(F.lit(1)).alias("alerted_items"),
        F.count_if(status == X.RESTOCK_NOW).alias("restock_now"),
        F.count_if(status == X.OUT_OF_STOCK).alias("out_of_stock"),
    )


def promotion_flagged(df: DataFrame) -> DataFrame:
    """Rows whose recommendation is not 'Healthy Inventory'."""
    return df.where(F.col("promotion_recommendation") != X.HEALTHY_INVENTORY)


def promotion_metrics(df: DataFrame) -> DataFrame:
    """The promotion tab's figures: rows, stock total and maximum, flagged rows."""
    flagged = F.count_if(F.col("promotion_recommendation") != X.HEALTHY_INVENTORY).alias("flagged")
    stock = F.col("stockquantity")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(stock).cast("double"), F.lit(0.0)).alias("total"),
        F.coalesce(F.max(stock).cast("double"), F.lit(0.0)).alias("highest"),
        flagged,
    )


def _text(c: Column) -> Column:
    """How Python prints a value in an f-string: NULL becomes 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _amount(c: Column) -> Column:
    """``f"{v:,.2f}"``: thousands commas, two places, 'nan' for a missing value."""
    return F.coalesce(F.format_number(c, 2), F.lit("nan"))


def simple_insight(df: DataFrame, name_col: str, value_col: str, subject: str) -> DataFrame:
    """Strongest and weakest row by ``value_col`` and the sentence about them.

    The dashboard sorts descending and takes the first and last row; a missing value
    sorts last, so it is the weakest.  ``max``/``min`` of ``struct(value, name)``
    reproduce that in one pass (a NULL value ranks lowest), and break ties by name.
    """
    if name_col not in df.columns or value_col not in df.columns:
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", F.lit(None).cast("string").alias("strongest"), F.lit(None).cast("double").alias("strongest_value"),
            F.lit(None).cast("string").alias("weakest"), F.lit(None).cast("double").alias("weakest_value"),
            F.lit(NO_RECORDS).alias("insight"))
    pair = F.struct(F.col(value_col).cast("double").alias("v"), F.col(name_col).cast("string").alias("n"))
    agg = df.agg(F.count(F.lit(1)).alias("row_count"), F.max(pair).alias("top"), F.min(pair).alias("bottom"))
    top_n, top_v = F.col("top.n"), F.col("top.v")
    low_n, low_v = F.col("bottom.n"), F.col("bottom.v")
    sentence = (F.when(F.col("row_count") == 0, F.lit(NO_RECORDS))
                .when(F.col("row_count") == 1, F.format_string(SOLE_CONTRIBUTOR, _text(top_n), _amount(top_v)))
                .otherwise(F.format_string(STRONGEST_WEAKEST, _text(top_n), F.lit(subject), _amount(top_v),
                                           _text(low_n), _amount(low_v))))
    return agg.select(
        "row_count",
        top_n.alias("strongest"), top_v.alias("strongest_value"),
        low_n.alias("weakest"), low_v.alias("weakest_value"),
        sentence.alias("insight"),
    )


def weakest_pair(df: DataFrame) -> DataFrame:
    """Lowest-revenue warehouse/category row and its sentence (no row when empty).

    Ascending with a missing revenue last, ties by the names; a top-1, which Spark
    runs as a distributed take-ordered (each task keeps its best row).
    """
    rev = F.col("category_revenue")
    first = df.orderBy(rev.asc_nulls_last(), F.col("warehouse_name").asc_nulls_last(),
                       F.col("category_name").asc_nulls_last()).limit(1)
    return first.select(
        "warehouse_name", "category_name", "category_revenue",
        F.format_string(WEAKEST_PAIR, _text(F.col("warehouse_name")), _text(F.col("category_name")),
                        _amount(rev)).alias("insight"),
    )
