"""Stock alert feed: units sold from the event stream against static inventory.

Purchases are counted per (warehouse, product); each micro-batch adds its counts to the sums so far, joins
the pairs it has sold with the inventory table and applies the low-stock status of the inventory report to what remains on
the shelf.  Out of it come the current alert table and a feed of newly reached levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import expressions as X
from shelfwise.sources.catalog import RetailTables, load_driver_tables
from shelfwise.session import scratch_path
from shelfwise.streaming.sources import Sums, event_stream, read_epochs, run_available, write_epoch

# Fixed values of the event mapping: a purchase of one unit of product props.k in
# warehouse user_id % 25.
PURCHASE = "purchase"
WAREHOUSE_COUNT = 25
PRODUCT_PATH = "$.k"


def sold_counts(events: DataFrame) -> DataFrame:
    purchases = events.where(F.col("event_type") == PURCHASE).select(
        (F.col("user_id") % WAREHOUSE_COUNT).cast("long").alias("warehouseid"),
        F.get_json_object("props", PRODUCT_PATH).cast("long").alias("productid"))
    return purchases.groupBy("warehouseid", "productid").agg(F.count(F.lit(1)).alias("units_sold"))


def alerts(sold: DataFrame, inventory: DataFrame) -> DataFrame:
    """Counts against inventory: what remains, its status, alerted rows only."""
    joined = sold.join(inventory.select("warehouseid", "productid", "stockquantity", "reorderlevel"),
                       ["warehouseid", "productid"])
    remaining = F.greatest(F.col("stockquantity") - F.col("units_sold"), F.lit(0)).cast("long")
    out = joined.select("warehouseid", "productid", "stockquantity", "units_sold",
                        remaining.alias("remaining"), "reorderlevel")
    return (out.where(X.near_reorder(F.col("remaining"), F.col("reorderlevel")))
            .withColumn("inventory_status", X.inventory_status(F.col("remaining"), F.col("reorderlevel"))))


RESULT = ("warehouseid long, productid long, stockquantity int, units_sold long, remaining long, reorderlevel int, "
          "inventory_status string")
PAIR = ["warehouseid", "productid"]
SOLD = "warehouseid long, productid long, units_sold long"
#: Parts in which the registered feed lets the events arrive.
ARRIVALS = 3


def run_stock_alerts(spark: SparkSession, sf_dir: str, tables: RetailTables | None = None,
                     files_per_trigger: int | None = None, location: str | None = None) -> str:
    """Run the alert stream over everything available; returns its folder.

    The state is the units sold per pair, as sums with snapshots. Each epoch adds its own counts and compares, for the pairs it has
    sold, the level before with the level after: new levels are the epoch's part of the ``feed``. A
    repeated epoch writes the same again.
    """
    tables = tables or load_driver_tables(spark, sf_dir)
    inventory = tables.inventory

    def write(batch: DataFrame, epoch: int, folder: str) -> None:
        state = Sums(batch.sparkSession, f"{folder}/sold", SOLD, PAIR)
        new = state.add(sold_counts(batch), epoch)
        earlier = state.read(epoch).withColumnRenamed("units_sold", "earlier")
        total = new.join(earlier, PAIR, "left").withColumn("units_sold", F.col("units_sold") + F.coalesce("earlier", F.lit(0)))
        now = alerts(total.drop("earlier"), inventory).select(*[c.split()[0] for c in RESULT.split(", ")])
        known = alerts(total.where("earlier IS NOT NULL").select(*PAIR, F.col("earlier").alias("units_sold")), inventory) \
            .select(*PAIR, F.col("inventory_status").alias("known"))
        changed = now.join(known, PAIR, "left").where(~F.col("inventory_status").eqNullSafe(F.col("known"))).drop("known")
        write_epoch(changed, epoch, f"{folder}/feed")

    return run_available(event_stream(spark, sf_dir, files_per_trigger), "stock-alerts", write, output_mode="append", location=location)


def stream_stock_alerts(spark: SparkSession, sf_dir: str, tables: RetailTables | None = None,
                        files_per_trigger: int | None = None, location: str | None = None) -> DataFrame:
    """The current alert table."""
    tables = tables or load_driver_tables(spark, sf_dir)
    out = run_stock_alerts(spark, sf_dir, tables, files_per_trigger, location)
    return alerts(Sums(spark, f"{out}/sold", SOLD, PAIR).read(), tables.inventory)


def stock_alert_feed(spark: SparkSession, location: str) -> DataFrame:
    """Level changes in the order of the epochs: a pair appears once for each level it has reached."""
    return read_epochs(spark, f"{location.rstrip('/')}/feed", RESULT)


def stream_stock_alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of events that arrive in ``ARRIVALS`` parts, one after the other; ``epoch`` is the part."""
    folder, place = scratch_path(spark, "arriving-events"), scratch_path(spark, "stock-alert-feed")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    tables = load_driver_tables(spark, sf_dir)
    for part in range(ARRIVALS):
        events.where(F.pmod("event_id", F.lit(ARRIVALS)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        run_stock_alerts(spark, folder, tables, location=place)
    return stock_alert_feed(spark, place)
