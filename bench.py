"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

The nine retail tables are first derived from the test tables and stored once as
Parquet (timed as ``prepare_sec``), as a deployment would hold them, the two fact
tables bucketed by ``transactionid`` and the sale lines once more by date; each query then runs over the stored tables.
Streams read the test folder directly.  The same keys are then timed once as registered, deriving
the tables from the raw ones inside the query (``registered_raw_sec``).  Every
query is forced whole with a ``noop`` write: one warm-up, then the median of
``$BENCH_RUNS`` (default 3) runs.  DuckDB runs the oracle SQL of each key on the
same folder as a single-node yardstick.  Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "category_revenue", "category_revenue_filtered", "warehouse_performance", "warehouse_performance_category",
    "low_inventory", "warehouse_category", "promotion_candidates", "promotion_candidates_scoped",
    "kpi_low_inventory", "insight_category", "revenue_share", "filter_date_bounds", "adhoc_sql",
    "rule_reorder_contacts", "rule_worst_pairs", "trapped_capital",
    "stream_daily_sales", "stream_stock_alerts",
]


def _median_time(fn, runs: int) -> float:
    fn()  # warm-up
    times = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE

    from shelfwise.plans.registry import named_queries
    from shelfwise.session import build_session, scratch_path
    from shelfwise.sources.catalog import load_driver_tables, store_tables
    from shelfwise.sources.sale_lines import store_sale_lines

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    t0 = time.perf_counter()
    stored = store_tables(load_driver_tables(spark, sf_dir), scratch_path(spark, "bench-tables"),
                          files_per_table=cpus, fact_buckets=cpus)
    stored = store_sale_lines(stored, scratch_path(spark, "bench-lines"), files=cpus)
    prepare = round(time.perf_counter() - t0, 3)

    registry = named_queries()
    timings: dict[str, float] = {}
    for key in keys:
        q = registry[key]

        def run(q=q):
            df = q.run_raw(spark, sf_dir) if q.run_raw is not None else q.run(stored)
            df.write.format("noop").mode("overwrite").save()

        timings[key] = _median_time(run, runs)
        print(f"{key}: {timings[key]}s", file=sys.stderr, flush=True)

    # The registered callables derive the tables from the raw ones inside the query, as the oracle does.
    from shelfwise.plans.registry import spark_callables
    registered: dict[str, float] = {}
    for key, call in spark_callables().items():
        if key in keys:
            t0 = time.perf_counter()
            call(spark, sf_dir).write.format("noop").mode("overwrite").save()
            registered[key] = round(time.perf_counter() - t0, 3)

    yardstick: dict[str, float] = {}
    try:
        sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
        from harness import duckdb_connection
        con = duckdb_connection(sf_dir)
        for key in keys:
            if registry[key].oracle:
                yardstick[key] = _median_time(lambda k=key: con.execute(registry[k].oracle).fetchall(), runs)
    except Exception as exc:  # the yardstick is optional
        print(f"duckdb yardstick skipped: {exc}", file=sys.stderr)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "prepare_sec": prepare,
        "with_prepare_sec": round(sum(timings.values()) + prepare, 3),
        "registered_raw_sec": registered,
        "registered_raw_sum_sec": round(sum(registered.values()), 3),
        "duckdb_oracle_sec": yardstick,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
