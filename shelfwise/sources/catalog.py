"""The nine tables as one value, from the test data or from stored Parquet."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources import driver_tables as drv
from shelfwise.sources.schema import KEYS, SCHEMAS, TABLE_NAMES


@dataclass(frozen=True)
class RetailTables:
    spark: SparkSession
    warehouse: DataFrame
    category: DataFrame
    supplier: DataFrame
    member: DataFrame
    product: DataFrame
    productsupplier: DataFrame
    inventory: DataFrame
    salestransaction: DataFrame
    salestransactionitem: DataFrame
    #: Sale lines with their transaction's date and warehouse (``sources.sale_lines``), where they are stored. Whoever replaces
    #: one of the two fact tables replaces these as well, or sets them to None.
    sale_lines: DataFrame | None = None
    #: Whether both fact tables are stored in buckets of ``transactionid``.
    facts_bucketed: bool = False

    def table(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise ValueError(f"unknown table {name!r}; expected one of {', '.join(TABLE_NAMES)}")
        return getattr(self, name)

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temporary views."""
        for name in TABLE_NAMES:
            self.table(name).createOrReplaceTempView(prefix + name)


def load_driver_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    """Derive the nine tables from the TPC-H-style Parquet files in ``sf_dir``."""
    d = drv.DriverTables(spark, sf_dir)
    return RetailTables(
        spark=spark,
        warehouse=drv.warehouse(d),
        category=drv.category(d),
        supplier=drv.supplier(d),
        member=drv.member(d),
        product=drv.product(d),
        productsupplier=drv.productsupplier(d),
        inventory=drv.inventory(d),
        salestransaction=drv.salestransaction(d),
        salestransactionitem=drv.salestransactionitem(d),
    )


def load_stored_tables(spark: SparkSession, root: str) -> RetailTables:
    """Read nine tables stored as ``{root}/{name}`` Parquet folders with fixed schemas."""
    frames = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")
              for name in TABLE_NAMES}
    frames["product"] = frames["product"].withColumn("product_details", normal_json(F.col("product_details")))
    return RetailTables(spark=spark, **frames)


# A JSON string, or a number with zeros at the end of its fraction; strings are matched so that they stay as they are.
_JSON_TEXT = r'("(?:[^"\\]|\\.)*")'
_WHOLE = _JSON_TEXT + r"|(-?\d+)\.0+(?![0-9eE])"
_FRACTION = _JSON_TEXT + r"|(-?\d+\.\d*[1-9])0+(?![0-9eE])"


def normal_json(text):
    """One spelling for equal JSON documents, as it is a grouping key: keys in order, the last of repeated keys, numbers by
    value (``1``, ``1.0`` and ``1e0`` are one), no spaces. Other text stays.

    Repeated keys need ``spark.sql.variant.allowDuplicateKeys``, which is set here where the session leaves it unset.
    """
    spark = SparkSession.active()
    if spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    plain = F.to_json(F.try_parse_json(text))
    return F.coalesce(F.regexp_replace(F.regexp_replace(plain, _WHOLE, "$1$2"), _FRACTION, "$1$2"), text)


def respelled_details(t: RetailTables) -> RetailTables:
    """The tables as a store may hold them: every second product's details in other words for the same document (a repeated
    key, other white space), read back through ``normal_json``."""
    text = F.col("product_details")
    other = F.regexp_replace(F.regexp_replace(text, r"^\s*\{", '{ "season" : null, '), ":", " : ")
    details = F.when((F.col("productid") % 2 == 0) & F.get_json_object(text, "$.season").isNotNull(), other).otherwise(text)
    return replace(t, product=t.product.withColumn("product_details", normal_json(details)))


# The two fact tables meet on this key in every sales report.
FACT_TABLES = ("salestransaction", "salestransactionitem")
FACT_BUCKET_KEY = "transactionid"


def store_tables(tables: RetailTables, root: str, files_per_table: int | None = None,
                 fact_buckets: int | None = None, table_prefix: str = "shelfwise_") -> RetailTables:
    """Write the nine tables once as Parquet and return readers of the written copy.

    This is how a deployment would hold the data: the derivation (joins of the test
    tables) runs once instead of inside every report.  Rows are sorted by the table
    key within each file so that row-group statistics prune well on that key.

    With ``fact_buckets`` the two fact tables are written as tables bucketed (and
    sorted) by ``transactionid`` into the same number of buckets: a sort-merge join
    of items and transactions then needs no exchange on either side, and the
    per-transaction distinct count reuses that partitioning too.  Each bucket is
    written by one task (``repartition`` on the bucket key first), one file each.
    """
    spark = tables.spark
    bucketed: dict[str, DataFrame] = {}
    for name in TABLE_NAMES:
        df = tables.table(name).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])
        path = f"{root.rstrip('/')}/{name}"
        if fact_buckets and name in FACT_TABLES:
            (df.repartition(fact_buckets, FACT_BUCKET_KEY).write.mode("overwrite")
             .bucketBy(fact_buckets, FACT_BUCKET_KEY).sortBy(FACT_BUCKET_KEY)
             .option("path", path).saveAsTable(table_prefix + name))
            bucketed[name] = spark.table(table_prefix + name)
            continue
        if files_per_table:
            df = df.repartition(files_per_table, *KEYS[name])
        df.sortWithinPartitions(*KEYS[name]).write.mode("overwrite").parquet(path)
    stored = load_stored_tables(spark, root)
    if not bucketed:
        return stored
    frames = {name: bucketed.get(name, stored.table(name)) for name in TABLE_NAMES}
    return RetailTables(spark=spark, facts_bucketed=True, **frames)


__all__ = ["RetailTables", "load_driver_tables", "load_stored_tables", "store_tables"]
