"""Sale lines stored with the date and warehouse of their transaction, so that a date range prunes what is read.

The lines themselves carry no date: a report over three days would read all of them to find those of its transactions. Here
each line is written beside its transaction's date and warehouse, in folders by month and sorted by date within files. A
range then reads the folders of its months, and of these the row groups that overlap it; the reports over sale lines (O1, O4,
O5b) need no join of the two fact tables any more. Lines are dealt by ranges of (date, transaction), so a day or month
that holds a third of all rows is written by a third of the tasks.

Lines without a transaction are left out: they are in none of these reports. NULL dates go to the folder of the NULL month,
which no range reads. ``transactionid`` names one transaction. A later batch of whole transactions is appended as further files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.filters import Filters
from shelfwise.session import scratch_path
from shelfwise.sources.catalog import RetailTables
from shelfwise.sources.schema import MONEY

MONTH = "sale_month"
SCHEMA = T.StructType([
    T.StructField("transactionid", T.LongType()),
    T.StructField("productid", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("subtotal", MONEY),
    T.StructField("warehouseid", T.LongType()),
    T.StructField("transactiondate", T.TimestampType()),
    T.StructField(MONTH, T.DateType()),
])


def dated_lines(t: RetailTables) -> DataFrame:
    """The lines of the tables' transactions, in the stored columns."""
    tx = t.salestransaction.select("transactionid", "warehouseid", "transactiondate")
    lines = t.salestransactionitem.select("transactionid", "productid", "quantity", "subtotal").join(tx, "transactionid")
    lines = lines.withColumn(MONTH, F.trunc(F.col("transactiondate"), "month"))
    return lines.select(*[F.col(c.name).cast(c.dataType) for c in SCHEMA.fields])


def store_sale_lines(t: RetailTables, path: str, files: int | None = None, append: bool = False) -> RetailTables:
    """Write the lines to ``path`` and return the tables with a reader of all that is stored there."""
    order = ["transactiondate", "transactionid"]
    lines = dated_lines(t)
    dealt = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(MONTH, *order).write.mode("append" if append else "overwrite").partitionBy(MONTH).parquet(path)
    return with_sale_lines(t, path)


def with_sale_lines(t: RetailTables, path: str) -> RetailTables:
    return replace(t, sale_lines=t.spark.read.schema(SCHEMA).parquet(path))


def scratch_sale_lines(t: RetailTables) -> RetailTables:
    """The tables with their sale lines stored in the session's shared scratch folder."""
    return store_sale_lines(t, scratch_path(t.spark, "sale-lines"))


def in_range(f: Filters) -> Column:
    """The filter's range on stored lines: on the date, and on the month, which leaves out folders."""
    keep = f.date_in_range(F.col("transactiondate")) & F.col(MONTH).isNotNull()
    if f.start_date is not None:
        keep = keep & (F.col(MONTH) >= F.lit(f.start_date.replace(day=1)))
    if f.end_date is not None:
        keep = keep & (F.col(MONTH) <= F.lit(f.end_date.replace(day=1)))
    return keep
