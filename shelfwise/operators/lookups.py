"""Filter look-ups, the raw table viewer, free SQL and the liveness check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.filters import ALL
from shelfwise.operators import free_sql
from shelfwise.sources.catalog import RetailTables
from shelfwise.sources.schema import KEYS, TABLE_NAMES

# Fixed value: the raw viewer shows this many rows.
VIEWER_ROWS = 100


def _with_all_first(spark: SparkSession, values: DataFrame, col: str, id_col: str | None = None) -> DataFrame:
    """``["All"] + values`` as rows, ordered with "All" first, then by ``col``."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in values.schema.fields])
    all_row = spark.createDataFrame([tuple(ALL if f.name == col else None for f in schema.fields)], schema)
    is_all = (F.col(col) == F.lit(ALL)) & (F.col(id_col).isNull() if id_col else F.lit(True))
    return all_row.unionByName(values).orderBy(is_all.desc(), F.col(col).asc_nulls_last())


def filter_regions(t: RetailTables) -> DataFrame:
    """Distinct regions, NULL dropped, with "All" first."""
    regions = t.warehouse.select("region").where(F.col("region").isNotNull()).distinct()
    return _with_all_first(t.spark, regions, "region")


def filter_warehouses(t: RetailTables) -> DataFrame:
    """Warehouse ids and names by name (names not de-duplicated), with "All" first."""
    names = t.warehouse.select("warehouseid", "name").where(F.col("name").isNotNull())
    return _with_all_first(t.spark, names, "name", "warehouseid")


def filter_categories(t: RetailTables) -> DataFrame:
    names = t.category.select("categoryid", "name").where(F.col("name").isNotNull())
    return _with_all_first(t.spark, names, "name", "categoryid")


def filter_date_bounds(t: RetailTables) -> DataFrame:
    """First and last transaction day: the default and the limits of the date filter."""
    d = F.col("transactiondate")
    return t.salestransaction.agg(F.min(d).cast("date").alias("min_date"),
                                  F.max(d).cast("date").alias("max_date"))


def inspect_table(t: RetailTables, name: str, rows: int = VIEWER_ROWS) -> DataFrame:
    """``SELECT * FROM name LIMIT 100`` on one of the nine tables.

    The original has no ORDER BY, so any 100 rows would do; ordering by the table
    key, then the other columns, makes the answer repeatable.  The sort is a distributed top-k (each task
    keeps its first 100 rows), not a full sort.
    """
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}; choose one of {', '.join(TABLE_NAMES)}")
    df = t.table(name)
    return df.orderBy(*KEYS[name], *[c for c in df.columns if c not in KEYS[name]]).limit(rows)


def adhoc_sql(t: RetailTables, sql: str, args: dict | None = None, schema: str = free_sql.SCHEMA) -> DataFrame:
    """Free SQL over the nine tables, bare or as ``schema.table``, with optional named binds (see ``free_sql``)."""
    return free_sql.run({name: t.table(name) for name in TABLE_NAMES}, sql, args, schema)


def ping(spark: SparkSession) -> DataFrame:
    """Liveness check: ``SELECT 1 AS ok``."""
    return spark.sql("SELECT 1 AS ok")
