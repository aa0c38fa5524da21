"""Chart series: the data the dashboard's figures draw, computed in Spark.

Bars with equal x (and colour) are drawn stacked, so the visible value is their
sum; that sum is taken here, before anything leaves the cluster.  Global figures
(axis top, total for shares) come from one-row scalar subqueries: a single value,
so broadcasting it costs nothing whatever the data size, and no keyless window or
cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Axis head-room of the category chart and of the automatic chart.
CATEGORY_AXIS_FACTOR = 1.1
AUTO_AXIS_FACTOR = 1.2


def _total(col: str) -> Column:
    """Sum of decimals (exactly) or doubles, as DOUBLE at the edge."""
    return F.sum(col).cast("double")


def chart_category_revenue(o1: DataFrame) -> DataFrame:
    """Revenue per category name, with the y-axis top (largest bar × 1.1)."""
    by_name = o1.groupBy("category_name").agg(_total("total_revenue").alias("total_revenue"), F.max("total_revenue").alias("m"))
    axis_top = by_name.select(F.max("m").cast("double") * CATEGORY_AXIS_FACTOR).scalar()
    return by_name.select("category_name", "total_revenue", axis_top.alias("axis_top"))


def revenue_share(o1: DataFrame) -> DataFrame:
    """Pie data: revenue per category name and its share of the total (NULL where the total is 0)."""
    by_name = o1.groupBy("category_name").agg(F.sum("total_revenue").alias("s"))
    total = by_name.select(_total("s")).scalar()
    revenue = F.col("s").cast("double")
    return by_name.select("category_name", revenue.alias("total_revenue"), F.try_divide(revenue, total).alias("share"))


def chart_warehouse_revenue(o2: DataFrame) -> DataFrame:
    """Revenue per warehouse name, coloured by region."""
    return o2.groupBy("warehouse_name", "region").agg(_total("total_revenue").alias("total_revenue"))


def stock_vs_reorder(o3: DataFrame) -> DataFrame:
    """Wide to long: one row per (warehouse, product, metric) with the units."""
    return o3.select("warehouse_name", "product_name", "stockquantity", "reorderlevel").unpivot(
        ["warehouse_name", "product_name"], ["stockquantity", "reorderlevel"], "metric", "units")


def chart_stock_vs_reorder(o3: DataFrame) -> DataFrame:
    """The grouped bar chart's values: units per product and metric, summed."""
    return (stock_vs_reorder(o3).groupBy("product_name", "metric")
            .agg(F.sum("units").cast("long").alias("units")))


def chart_warehouse_category(o4: DataFrame) -> DataFrame:
    """Bar label "warehouse - category" (NULL if either is NULL), revenue, region."""
    label = F.concat(F.col("warehouse_name"), F.lit(" - "), F.col("category_name"))
    return o4.select(label.alias("warehouse_category"), "category_revenue", "region")


def chart_promotion_stock(o5: DataFrame) -> DataFrame:
    """Stock per product and recommendation (stacked bars)."""
    return (o5.groupBy("product_name", "promotion_recommendation")
            .agg(F.sum("stockquantity").cast("long").alias("stockquantity")))


# Text and dates are labels; every kind of number, decimals included, is a number.
_LABEL_TYPES = (T.StringType, T.DateType)
_NUMBER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def pick_auto_columns(df: DataFrame) -> tuple[str, str] | None:
    """First label column and first numeric column of a result, or None (table only)."""
    labels = [f.name for f in df.schema.fields if isinstance(f.dataType, _LABEL_TYPES)]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMBER_TYPES)]
    if not labels or not numbers:
        return None
    return labels[0], numbers[0]


def auto_series(df: DataFrame) -> DataFrame | None:
    """Automatic bar chart of any result: label × first number, summed per label,
    with the y-axis top (largest value × 1.2).  None when the result has no pair."""
    picked = pick_auto_columns(df)
    if picked is None:
        return None
    x, y = picked
    whole = isinstance(df.schema[y].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    by_label = df.groupBy(x).agg((F.sum(y).cast("long") if whole else _total(y)).alias(y), F.max(y).alias("_max"))
    axis_top = by_label.select(F.max("_max").cast("double") * AUTO_AXIS_FACTOR).scalar()
    return by_label.select(x, y, axis_top.alias("axis_top"))
