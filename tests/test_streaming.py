"""Streams: several files, several batches, a stop and a resume give the batch result."""

from __future__ import annotations

import pytest
from conftest import SMALL_SF
from pyspark.sql import functions as F

from shelfwise.sources.catalog import load_driver_tables
from shelfwise.streaming import daily_sales, stock_alerts
from shelfwise.streaming.sources import Sums


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _arrive(spark, folder, part, of=4):
    """One more file of events in the folder."""
    events = spark.read.parquet(f"{SMALL_SF}/events.parquet").where(F.col("event_id") % of == part)
    events.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_daily_sales_over_arriving_files_equals_batch(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        _arrive(spark, folder, part)
    daily_sales.stream_daily_sales(spark, folder, files_per_trigger=1, location=place)
    _arrive(spark, folder, 3)
    streamed = daily_sales.stream_daily_sales(spark, folder, files_per_trigger=1, location=place)  # resumes
    batch_events = spark.read.parquet(f"{SMALL_SF}/events.parquet")
    batch = daily_sales.shape(daily_sales.daily_sales_aggregation(batch_events))
    assert len(list((tmp_path / "out" / "totals" / "delta").glob("epoch=*"))) >= 4
    assert _rows(streamed.select(*batch.columns)) == _rows(batch)


def test_single_file_stream_equals_batch(spark):
    streamed = daily_sales.stream_daily_sales(spark, SMALL_SF)
    batch_events = spark.read.parquet(f"{SMALL_SF}/events.parquet")
    assert streamed.agg(F.sum("events")).first()[0] == batch_events.count()


def test_alerts_over_arriving_files(spark, tmp_path):
    tables = load_driver_tables(spark, SMALL_SF)
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        _arrive(spark, folder, part)
    stock_alerts.run_stock_alerts(spark, folder, tables, 1, place)
    _arrive(spark, folder, 3)
    current = stock_alerts.stream_stock_alerts(spark, folder, tables, 1, place)
    sold = stock_alerts.sold_counts(spark.read.parquet(f"{SMALL_SF}/events.parquet"))
    batch = stock_alerts.alerts(sold, tables.inventory)
    assert _rows(current.select(*batch.columns)) == _rows(batch)
    feed = stock_alerts.stock_alert_feed(spark, place)
    assert feed.count() == feed.select("warehouseid", "productid", "inventory_status").distinct().count() > 0
    assert feed.select("warehouseid", "productid").distinct().count() == batch.count()


def test_no_batch_yet_is_an_empty_table(spark, tmp_path):
    assert stock_alerts.stock_alert_feed(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("order", [[3, 0, 2, 1], [2, 3, 1, 0]])
def test_daily_sales_do_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    """Every part holds one quarter of the time line, so with all but one order most rows are late by days."""
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{SMALL_SF}/events.parquet")
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * 4 / (high - low + 1)), F.lit(3))
    for part in order:
        events.where(at == part).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        streamed = daily_sales.stream_daily_sales(spark, folder, files_per_trigger=1, location=place)
    assert _rows(streamed) == _rows(daily_sales.shape(daily_sales.daily_sales_aggregation(events)))


def test_sums_read_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Sums, "EVERY", 3)
    sums = Sums(spark, str(tmp_path / "s"), "k string, n long", ["k"])
    assert sums.read().count() == 0
    for epoch in range(8):
        sums.add(spark.createDataFrame([("a", 1), ("b", epoch), ("a", 1)], "k string, n long"), epoch)
        assert len(sums.folders()) <= 3
    assert _rows(sums.read()) == [("a", 16), ("b", 28)]
    sums.add(spark.createDataFrame([("a", 2), ("b", 5)], "k string, n long"), 5)  # an epoch whose commit was lost runs again
    assert _rows(sums.read()) == [("a", 16), ("b", 28)]
    assert _rows(sums.read(4)) == [("a", 8), ("b", 6)]


def test_feed_names_each_level_once(spark):
    feed = stock_alerts.stream_stock_alert_feed(spark, SMALL_SF)
    assert feed.count() == feed.select("warehouseid", "productid", "inventory_status").distinct().count()
