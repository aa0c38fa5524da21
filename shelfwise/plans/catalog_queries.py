"""Registration of every query key (imported once by ``registry``)."""

from __future__ import annotations

from shelfwise.operators import reports as R
from shelfwise.operators.rollup import arriving_sales
from shelfwise.plans import oracle as O
from shelfwise.plans.registry import CATEGORY_ONLY, NARROW, OPEN, THREE_DAYS, register, register_raw
from shelfwise.sources.catalog import respelled_details
from shelfwise.sources.sale_lines import scratch_sale_lines

# -- O1 .. O5b: business reports ----------------------------------------------
register("category_revenue", lambda t: R.category_revenue(t, OPEN), O.with_tables(O.category_revenue(OPEN)))
register("category_revenue_filtered", lambda t: R.category_revenue(t, NARROW), O.with_tables(O.category_revenue(NARROW)))
register("warehouse_performance", lambda t: R.warehouse_performance(t, OPEN), O.with_tables(O.warehouse_performance(OPEN)))
register("warehouse_performance_filtered", lambda t: R.warehouse_performance(t, NARROW),
         O.with_tables(O.warehouse_performance(NARROW)))
register("warehouse_performance_category", lambda t: R.warehouse_performance(t, CATEGORY_ONLY),
         O.with_tables(O.warehouse_performance(CATEGORY_ONLY)))
register("warehouse_performance_narrow", lambda t: R.warehouse_performance(t, THREE_DAYS),
         O.with_tables(O.warehouse_performance(THREE_DAYS)))
register("low_inventory", lambda t: R.low_inventory(t, OPEN), O.with_tables(O.low_inventory(OPEN)))
register("low_inventory_filtered", lambda t: R.low_inventory(t, NARROW), O.with_tables(O.low_inventory(NARROW)))
register("warehouse_category", lambda t: R.warehouse_category(t, OPEN), O.with_tables(O.warehouse_category(OPEN)))
register("warehouse_category_filtered", lambda t: R.warehouse_category(t, NARROW), O.with_tables(O.warehouse_category(NARROW)))
register("promotion_candidates", lambda t: R.promotion_candidates(t, OPEN), O.with_tables(O.promotion_candidates(OPEN)))
register("promotion_candidates_filtered", lambda t: R.promotion_candidates(t, NARROW),
         O.with_tables(O.promotion_candidates(NARROW)))
register("promotion_candidates_scoped", lambda t: R.promotion_candidates_scoped(t, NARROW),
         O.with_tables(O.promotion_candidates_scoped(NARROW)))

register("promotion_candidates_scoped_open", lambda t: R.promotion_candidates_scoped(t, OPEN),
         O.with_tables(O.promotion_candidates_scoped(OPEN)))
register("promotion_candidates_respelled", lambda t: R.promotion_candidates(respelled_details(t), OPEN),
         O.with_tables(O.promotion_candidates(OPEN)))
register("low_inventory_ordered", lambda t: R.low_inventory_ordered(t, OPEN), O.with_tables(O.low_inventory_ordered(OPEN)))
register("warehouse_category_bottom10", lambda t: R.warehouse_category_bottom(t, OPEN, 10),
         O.with_tables(O.warehouse_category_bottom(OPEN, 10)))

# -- K: key figures and insights over the reports ------------------------------
from shelfwise.operators import kpis as K  # noqa: E402
from shelfwise.operators import lookups as L  # noqa: E402
from shelfwise.operators import rules as P  # noqa: E402
from shelfwise.operators import series as C  # noqa: E402
from shelfwise.sources.schema import KEYS, TABLE_NAMES  # noqa: E402

register("kpi_category", lambda t: K.show_metrics(R.category_revenue(t, OPEN, exact=True), "total_revenue"),
         O.metrics(O.category_revenue(OPEN), "total_revenue"))
register("kpi_warehouse", lambda t: K.show_metrics(R.warehouse_performance(t, OPEN, exact=True), "total_revenue"),
         O.metrics(O.warehouse_performance(OPEN), "total_revenue"))
register("kpi_warehouse_category", lambda t: K.show_metrics(R.warehouse_category(t, OPEN, exact=True), "category_revenue"),
         O.metrics(O.warehouse_category(OPEN), "category_revenue"))
register("kpi_promotion", lambda t: K.promotion_metrics(R.promotion_candidates(t, OPEN)),
         O.promotion_metrics(O.promotion_candidates(OPEN)))
register("kpi_low_inventory", lambda t: K.low_inventory_metrics(R.low_inventory(t, OPEN)),
         O.low_inventory_metrics(O.low_inventory(OPEN)))
register("promotion_flagged", lambda t: K.promotion_flagged(R.promotion_candidates(t, NARROW)),
         O.promotion_flagged(O.promotion_candidates(NARROW)))
register("promotion_flagged_open", lambda t: K.promotion_flagged(R.promotion_candidates(t, OPEN)),
         O.promotion_flagged(O.promotion_candidates(OPEN)))
register("insight_category",
         lambda t: K.simple_insight(R.category_revenue(t, OPEN), "category_name", "total_revenue", "category"),
         O.insight(O.category_revenue(OPEN), "category_name", "total_revenue", "category"))
register("insight_category_single",
         lambda t: K.simple_insight(R.category_revenue(t, NARROW), "category_name", "total_revenue", "category"),
         O.insight(O.category_revenue(NARROW), "category_name", "total_revenue", "category"))
register("insight_warehouse",
         lambda t: K.simple_insight(R.warehouse_performance(t, OPEN), "warehouse_name", "total_revenue", "warehouse"),
         O.insight(O.warehouse_performance(OPEN), "warehouse_name", "total_revenue", "warehouse"))
register("insight_weakest_pair", lambda t: K.weakest_pair(R.warehouse_category(t, OPEN)),
         O.weakest_pair(O.warehouse_category(OPEN)))

# -- C: chart series ------------------------------------------------------------
register("chart_category_revenue", lambda t: C.chart_category_revenue(R.category_revenue(t, OPEN, exact=True)),
         O.chart_category_revenue(O.category_revenue(OPEN)))
register("revenue_share", lambda t: C.revenue_share(R.category_revenue(t, OPEN, exact=True)),
         O.revenue_share(O.category_revenue(OPEN)))
register("chart_warehouse_revenue", lambda t: C.chart_warehouse_revenue(R.warehouse_performance(t, OPEN, exact=True)),
         O.chart_warehouse_revenue(O.warehouse_performance(OPEN)))
register("stock_vs_reorder", lambda t: C.stock_vs_reorder(R.low_inventory(t, OPEN)),
         O.stock_vs_reorder(O.low_inventory(OPEN)))
register("chart_stock_vs_reorder", lambda t: C.chart_stock_vs_reorder(R.low_inventory(t, OPEN, ordered=False)),
         O.chart_stock_vs_reorder(O.low_inventory(OPEN)))
register("chart_warehouse_category", lambda t: C.chart_warehouse_category(R.warehouse_category(t, OPEN)),
         O.chart_warehouse_category(O.warehouse_category(OPEN)))
register("chart_promotion_stock", lambda t: C.chart_promotion_stock(R.promotion_candidates(t, OPEN)),
         O.chart_promotion_stock(O.promotion_candidates(OPEN)))
register("auto_series", lambda t: C.auto_series(R.warehouse_category(t, OPEN, exact=True)),
         O.auto_series_money(O.warehouse_category(OPEN), "warehouse_name", "category_revenue"))

# -- L: look-ups, viewer, free SQL ---------------------------------------------
register("filter_regions", L.filter_regions, O.FILTER_REGIONS)
register("filter_warehouses", L.filter_warehouses, O.FILTER_WAREHOUSES)
register("filter_categories", L.filter_categories, O.FILTER_CATEGORIES)
register("filter_date_bounds", L.filter_date_bounds, O.FILTER_DATE_BOUNDS)
for _table in TABLE_NAMES:
    register(f"inspect_{_table}", lambda t, _n=_table: L.inspect_table(t, _n), O.inspect(_table, KEYS[_table]))
register("adhoc_sql", lambda t: L.adhoc_sql(t, O.ADHOC_SQL, O.ADHOC_ARGS), O.adhoc_oracle())

register("adhoc_schema_sql", lambda t: L.adhoc_sql(t, O.ADHOC_SCHEMA_SQL), O.with_tables("select * from (" + O.ADHOC_SCHEMA_SQL.replace("retail.", "") + ")"))
register("auto_series_adhoc", lambda t: C.auto_series(L.adhoc_sql(t, O.ADHOC_SERIES_SQL)), O.auto_series_adhoc())

# -- P: copilot rules ------------------------------------------------------------
register("rule_category_revenue", P.rule_category_revenue, O.RULE_CATEGORY_REVENUE)
register("rule_warehouse_sales", lambda t: P.rule_warehouse_sales(t, P.order_for("Which warehouses are underperforming?")), O.RULE_WAREHOUSE_SALES)
register("rule_reorder_contacts", P.rule_reorder_contacts, O.RULE_REORDER_CONTACTS)
register("rule_worst_pairs", P.rule_worst_pairs, O.rule_worst_pairs())
register("trapped_capital", P.trapped_capital, O.TRAPPED_CAPITAL)
register("trapped_capital_recent", lambda t: P.trapped_capital(t, THREE_DAYS), O.trapped_capital(THREE_DAYS))
register("search_warehouses", lambda t: P.search_warehouses(t, "nation_1"), O.search_warehouses("nation_1"))
register("search_products", lambda t: P.search_products(t, "RED W"), O.search_products("RED W"))

# -- O1, O2, O4 from the roll-up -------------------------------------------------
register("rollup_category_revenue", lambda t: arriving_sales(t).category_revenue(OPEN), O.with_tables(O.category_revenue(OPEN)))
register("rollup_category_revenue_filtered", lambda t: arriving_sales(t).category_revenue(NARROW), O.with_tables(O.category_revenue(NARROW)))
register("rollup_warehouse_performance", lambda t: arriving_sales(t).warehouse_performance(THREE_DAYS),
         O.with_tables(O.warehouse_performance(THREE_DAYS)))
register("rollup_warehouse_performance_category", lambda t: arriving_sales(t).warehouse_performance(CATEGORY_ONLY),
         O.with_tables(O.warehouse_performance(CATEGORY_ONLY)))
register("rollup_warehouse_category", lambda t: arriving_sales(t).warehouse_category(CATEGORY_ONLY),
         O.with_tables(O.warehouse_category(CATEGORY_ONLY)))

# -- O1, O4, O5b from lines stored by date ---------------------------------------
register("dated_category_revenue", lambda t: R.category_revenue(scratch_sale_lines(t), THREE_DAYS), O.with_tables(O.category_revenue(THREE_DAYS)))
register("dated_category_revenue_filtered", lambda t: R.category_revenue(scratch_sale_lines(t), NARROW), O.with_tables(O.category_revenue(NARROW)))
register("dated_warehouse_category", lambda t: R.warehouse_category(scratch_sale_lines(t), CATEGORY_ONLY),
         O.with_tables(O.warehouse_category(CATEGORY_ONLY)))
register("dated_promotion_candidates_scoped", lambda t: R.promotion_candidates_scoped(scratch_sale_lines(t), NARROW),
         O.with_tables(O.promotion_candidates_scoped(NARROW)))

# -- X: streams ---------------------------------------------------------------
from shelfwise.streaming.daily_sales import stream_daily_sales, stream_daily_sales_arriving  # noqa: E402
from shelfwise.streaming.stock_alerts import stream_stock_alert_feed, stream_stock_alerts  # noqa: E402

register_raw("stream_daily_sales", stream_daily_sales, O.STREAM_DAILY_SALES)
register_raw("stream_daily_sales_arriving", stream_daily_sales_arriving, O.STREAM_DAILY_SALES)
register_raw("stream_stock_alerts", stream_stock_alerts, O.STREAM_STOCK_ALERTS)
register_raw("stream_stock_alert_feed", stream_stock_alert_feed, O.STREAM_STOCK_ALERT_FEED)
