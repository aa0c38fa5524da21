"""Incremental event counts and values per day and event type.

The dashboard re-runs its reports every minute; as a stream, the totals are kept up to date instead. A batch
adds its own counts and exact sums; nothing is kept in event-time state that would forget, so an event counts in its
day however late it arrives and in whatever order files come.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import expressions as X
from shelfwise.session import scratch_path
from shelfwise.streaming.sources import Sums, event_stream, run_available

PARTIAL = "day date, event_type string, events long, cents long"
KEYS = ["day", "event_type"]
#: Files that the registered run over arriving files deals the events into.
ARRIVALS = 6


def daily_sales_aggregation(events: DataFrame) -> DataFrame:
    """Events and exact value in cents per day and type, of one batch or of all rows."""
    ev = events.select(F.col("ts").cast("date").alias("day"), "event_type",
                       (F.col("value").cast("decimal(12,2)") * F.lit(Decimal(100))).cast("long").alias("cents"))
    return ev.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents"))


def shape(agg: DataFrame) -> DataFrame:
    return agg.select("day", "event_type", "events", X.money(F.col("cents")).alias("total_value"))


def stream_daily_sales(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None,
                       location: str | None = None) -> DataFrame:
    """Run the stream over everything available and read the totals."""
    def write(batch: DataFrame, epoch: int, folder: str) -> None:
        Sums(batch.sparkSession, f"{folder}/totals", PARTIAL, KEYS).add(daily_sales_aggregation(batch), epoch)

    out = run_available(event_stream(spark, sf_dir, files_per_trigger), "daily-sales", write, output_mode="append", location=location)
    return shape(Sums(spark, f"{out}/totals", PARTIAL, KEYS).read())


def stream_daily_sales_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a folder of several files, one a batch, into which days are dealt at random: most events are late."""
    folder = scratch_path(spark, "arriving-events")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    events.repartition(ARRIVALS, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return stream_daily_sales(spark, folder, files_per_trigger=1)
