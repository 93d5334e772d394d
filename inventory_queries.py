"""Every query of the library, run on the star-schema tables of a directory."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions import classes as C
from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.ml import actions, anomaly, cluster, features, forecast
from stocklens.operators import joins, prefix, select, selection
from stocklens.operators.aggregates import critical_count, value_counts
from stocklens.operators.ordering import top_k
from stocklens.plans import alerts, finance, frame, kpis, sales, stock, suite, views
from stocklens.sources import quality, sinks, star
from stocklens.sources.scratch import SETTING, materialized, run_path
from stocklens.sources.star import AS_OF
from stocklens.sources.tables import Tables
from stocklens.streaming import crossings, delta_runs, ledger, ledger_stream, live, reorder, settling, snapshot

Query = Callable[[SparkSession, str], DataFrame]

# Small cells, so that the bucketed path runs at test scale too.
SMALL_CELL = 64


@dataclass(frozen=True)
class Report:
    """A query that may look back a number of days only."""

    make: Callable[[SparkSession, str, int | None], DataFrame]
    days: int | None = None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.make(spark, directory, self.days)


def _tables(report: Callable[[Tables], DataFrame], suppliers: bool = False) -> Report:
    """A report on the tables; ``suppliers`` when it looks at the main supplier."""
    return Report(lambda spark, d, days: report(
        star.star_tables(spark, d, main_supplier=suppliers, days=days)))


def _selection(report: Callable[[DataFrame], DataFrame], *dims: str) -> Report:
    """A report on the analysis frame of all active products with some dimensions."""
    def make(spark: SparkSession, d: str, days: int | None) -> DataFrame:
        t = star.star_tables(spark, d, main_supplier="suppliers" in dims, days=days)
        return report(frame.analysis_frame(t, dims=dims))

    return Report(make)


def _products(report: Callable[[DataFrame], DataFrame], suppliers: bool = False) -> Report:
    return Report(lambda spark, d, days: report(
        star.products(spark, d, main_supplier=suppliers, days=days)))


def _measure(transform: Callable[[DataFrame], DataFrame], *columns: str) -> Report:
    return _products(lambda p: transform(p).select("product_id", *columns))


def _label(column) -> Report:
    """A classification of every product; the column is built per call."""
    return _products(lambda p: p.select("product_id", column().alias("label")))


def _digits(df: DataFrame, column: str) -> DataFrame:
    """A mean of doubles to the digits that do not depend on the order of adding."""
    return df.withColumn(column, F.round(column, 6))


# Measures ------------------------------------------------------------------

MEASURES: dict[str, Query] = {
    "with_margin": _measure(
        M.with_margin, "unit_profit", "margin_pct", "profit_month", "stock_value"
    ),
    "with_revenue": _measure(M.with_revenue, "revenue_month", "cost_month"),
    "with_turnover": _measure(M.with_turnover, "turnover_month"),
    "with_months_of_stock": _products(lambda p: p.select(
        "product_id",
        M.months_of_stock().alias("months_or_null"),
        M.months_of_stock(need_stock=True).alias("months_strict"),
        M.months_of_stock(no_sales=L.NO_SALES_MONTHS).alias("months_or_999"),
    )),
    "with_annual_turnover": _products(lambda p: p.select(
        "product_id",
        M.turnover_year().alias("turnover_rounded"),
        M.turnover_year(digits=None).alias("turnover_raw"),
    )),
    "with_days_of_stock": _products(lambda p: p.select(
        "product_id",
        M.days_of_stock().alias("days"),
        M.days_of_stock_text().alias("days_text"),
    )),
    "with_growth": _products(lambda p: p.select(
        "product_id", M.growth().alias("fraction"), F.round(M.growth_pct(), 2).alias("pct")
    )),
    "with_projection": _products(lambda p: p.select(
        "product_id",
        M.projection().alias("half_up"),
        M.projection(half_even=True).alias("half_even"),
    )),
    "with_reorder_qty": _measure(M.with_reorder_qty, "reorder_qty", "investment"),
    "with_suggested_purchase": _measure(
        lambda p: M.with_suggested_purchase(M.with_projection(p)), "suggested_purchase"
    ),
    "with_idle": _measure(
        lambda p: M.with_idle(p, AS_OF), "idle_days", "tied_up_value", "clearance_price"
    ),
    "with_averages": _measure(M.with_averages, "avg_quarter", "avg_year"),
    "location_code": lambda spark, d: star.locations(spark, d).select(
        "location_id",
        M.location_code().alias("four_parts"),
        M.location_code(("section", "aisle", "shelf")).alias("three_parts"),
    ),
}

# Classifications -----------------------------------------------------------

CLASSES: dict[str, Query] = {
    "stock_state4": _label(C.stock_state4),
    "stock_state4_icon": _label(lambda: C.stock_state4(L.STATE_ICON)),
    "stock_state3": _label(C.stock_state3),
    "turnover_class_annual": _label(lambda: C.turnover_class_annual(M.turnover_year())),
    "turnover_class_months": _label(
        lambda: C.turnover_class_months(M.months_of_stock(no_sales=L.NO_SALES_MONTHS))
    ),
    "season_class": _label(C.season_class),
    "future_stock_risk": _label(lambda: C.future_stock_risk(M.projection())),
    "stockout_risk": _label(lambda: C.stockout_risk(M.projection(half_even=True))),
    "reorder_priority": _label(C.reorder_priority),
    "idle_priority": _label(lambda: C.idle_priority(M.idle_days(AS_OF))),
    "anomaly_kind": _label(lambda: C.anomaly_kind(F.col("sales_quarter") > 100)),
}

# Selections, joins, aggregates, windows ------------------------------------


def _picked(spark: SparkSession, d: str) -> DataFrame:
    df = frame.analysis_frame(star.star_tables(spark, d))
    chosen = select.select_inventory(
        df, category="SMALL", supplier=L.ALL_SUPPLIERS, states=L.STATE_ICON[:2]
    )
    return chosen.select("product_id", "category", "supplier", "stock_state")


def _enriched_keys(spark: SparkSession, d: str) -> DataFrame:
    t = star.star_tables(spark, d)
    return joins.enrich(t.products, t.categories, t.suppliers, t.locations).select(
        "product_id", "active", "category", "supplier", "supplier_active", "supplier_rating",
        "location_code", "location_capacity",
    )


def _inner(spark: SparkSession, d: str) -> DataFrame:
    t = star.star_tables(spark, d)
    return joins.join_dims(t.products, t.categories, t.suppliers).select(
        "product_id", "category", "supplier", "lead_days"
    )


def _left(spark: SparkSession, d: str) -> DataFrame:
    """Products against the fast suppliers only: the rest keep NULL names."""
    t = star.star_tables(spark, d)
    fast = t.suppliers.filter("lead_days <= 5")
    return joins.join_dims(t.products, suppliers=fast, how="left").select(
        "product_id", "supplier", "lead_days"
    )


def _conditional_counts(p: DataFrame) -> DataFrame:
    return p.agg(
        critical_count().alias("critical_products"),
        F.count_if(F.col("stock") > 0).alias("in_stock"),
        F.count("last_sale").alias("ever_sold"),
        F.count("*").alias("products"),
    )


def _quantiles(p: DataFrame) -> DataFrame:
    """Exact quantiles of sales and stock, by the bounded and the bucketed path."""
    probabilities = [0.3, 0.7, 0.8]
    rows = []
    for column in ("sales_month", "stock"):
        plain = prefix.quantiles(p, column, probabilities)
        bucketed = prefix.quantiles(p, column, probabilities, rows_per_cell=8)
        rows += [
            (column, q, float(a), float(b)) for q, a, b in zip(probabilities, plain, bucketed)
        ]
    schema = "measure string, probability double, plain double, bucketed double"
    return p.sparkSession.createDataFrame(rows, schema)


def _quantiles_selected(p: DataFrame) -> DataFrame:
    """The same by sketch and selection; fetching few values makes it narrow brackets here too."""
    wanted = {"sales_month": [0.3, 0.7, 0.8], "stock": [0.3, 0.7, 0.8]}
    found = [selection.exact_quantiles(p, wanted, fetched=f) for f in (selection.FETCHED, 20)]
    rows = [(c, q, *(x[c][i] for x in found)) for c, qs in wanted.items() for i, q in enumerate(qs)]
    schema = "measure string, probability double, plain double, bucketed double"
    return p.sparkSession.createDataFrame(rows, schema)


def _quintiles(p: DataFrame) -> DataFrame:
    scored = p.select("product_id", F.col("price").cast("double").alias("score"))
    return prefix.quintile_label(scored, "score", L.ANOMALY_QUINTILES, "label")


def _sold(p: DataFrame) -> DataFrame:
    return p.filter("sales_month > 0").select("product_id", "sales_month")


OPERATORS: dict[str, Query] = {
    "active": _products(lambda p: select.active(p).select("product_id")),
    "select_inventory": _picked,
    "facets": _selection(lambda df: select.facets(df, "supplier"), "suppliers"),
    "critical": _products(lambda p: select.critical(p).select("product_id", "stock")),
    "slow_moving": _products(lambda p: select.slow_moving(p, AS_OF).select("product_id")),
    "idle": _products(lambda p: select.idle(p, AS_OF).select("product_id", "last_sale")),
    "notable_forecasts": _selection(
        lambda df: select.notable_forecasts(sales.forecast_frame(df)).select(
            "product_id", "projection", "suggested_purchase"
        )
    ),
    "active_alerts": lambda spark, d: select.active_alerts(star.alerts(spark, d)).select(
        "alert_id", "product_id", "message", "priority", "raised_at"
    ),
    "join_dims": _inner,
    "join_dims_left": _left,
    "enrich": _enriched_keys,
    "location_left_join": _tables(
        lambda t: joins.location_left_join(t.locations, t.products).select(
            "location_id", "products", "units", "value"
        )
    ),
    "supplier_join": _tables(
        lambda t: joins.supplier_join(t.suppliers, t.products).select("supplier_id", "product_id"),
        suppliers=True,
    ),
    "conditional_counts": _products(_conditional_counts),
    "value_counts": _selection(lambda df: value_counts(df, "stock_state")),
    "mean_turnover": _selection(lambda df: _digits(
        df.agg(kpis.mean_turnover().alias("mean_turnover")), "mean_turnover")),
    "quantiles": _products(_quantiles),
    "quantiles_by_selection": _products(_quantiles_selected),
    "global_rank": _products(lambda p: prefix.global_rank(_sold(p), "sales_month")),
    "global_row_number": _products(
        lambda p: prefix.global_row_number(_sold(p), "sales_month")
    ),
    "running_total": _products(
        lambda p: prefix.running_total(_sold(p), "sales_month", "sales_month")
    ),
    "distributed_prefix": _products(lambda p: prefix.distributed_prefix(
        p.select("product_id", "sales_month"), "sales_month", "product_id",
        rank="rank", row_number="row_number", running=("sales_month", "running"),
        rows_per_cell=SMALL_CELL,
    )),
    "with_totals": _selection(finance.revenue_share),
    "quintile_label": _products(_quintiles),
    "dense_codes": _products(
        lambda p: prefix.dense_codes(p.select("product_id", "supplier_id"), "supplier_id", "code"),
        suppliers=True,
    ),
    "top_k": _selection(sales.best_sellers),
    "union_alert_kinds": _tables(
        lambda t: alerts.auto_alerts(t, AS_OF).groupBy("alert_kind", "priority").agg(
            F.count("*").alias("alerts"), F.sum("investment").cast(M.AMOUNT).alias("investment")
        ),
        suppliers=True,
    ),
}

# Views and reports ---------------------------------------------------------


def _registered_views(spark: SparkSession, d: str) -> DataFrame:
    views.register(star.star_tables(spark, d))
    return spark.sql(
        "SELECT category, count(*) AS products, sum(profit_month) AS profit_month "
        "FROM vista_rentabilidad GROUP BY category"
    )


def _suite(spark: SparkSession, d: str) -> DataFrame:
    """The standard set, as rows per report."""
    outcomes = suite.run_report_suite(star.star_tables(spark, d))
    return sinks.table_stats({n: o.result for n, o in outcomes.items()}).withColumnsRenamed(
        {"table_name": "report", "live_rows": "rows"}
    )


def _suite_shared(spark: SparkSession, d: str) -> DataFrame:
    """The same from one product snapshot, which all reports read."""
    outcomes = suite.run_report_suite(suite.shared_tables(star.star_tables(spark, d)))
    return sinks.table_stats({n: o.result for n, o in outcomes.items()}).withColumnsRenamed(
        {"table_name": "report", "live_rows": "rows"}
    )


REPORTS: dict[str, Query] = {
    "view_critical_stock": _tables(views.critical_stock, suppliers=True),
    "view_profitability": _tables(views.profitability),
    "view_top_products": _tables(views.top_products),
    "view_top_products_bucketed": _tables(
        lambda t: views.top_products(t, rows_per_cell=SMALL_CELL)
    ),
    "register_views": _registered_views,
    "top10_sales": _tables(sales.top10_sales, suppliers=True),
    "urgent_reorder": _tables(stock.urgent_reorder, suppliers=True),
    "category_profitability": _tables(finance.category_profitability),
    "category_profitability_brief": _tables(finance.category_profitability_brief),
    "top15_profitable": _tables(finance.top15_profitable),
    "supplier_performance": _tables(finance.supplier_performance, suppliers=True),
    "inventory_turnover": _tables(stock.inventory_turnover),
    "slow_movers": _tables(lambda t: stock.slow_movers(t, AS_OF)),
    "location_utilization": _tables(stock.location_utilization),
    "sales_projection": _tables(sales.sales_projection),
    "executive_kpis": _tables(kpis.executive_kpis),
    "abc_analysis": _tables(finance.abc_analysis),
    "abc_analysis_bucketed": _tables(
        lambda t: finance.abc_analysis(t, rows_per_cell=SMALL_CELL)
    ),
    "auto_alerts": _tables(lambda t: alerts.auto_alerts(t, AS_OF), suppliers=True),
    "monthly_comparison": _tables(sales.monthly_comparison),
    "seasonal_patterns": _tables(sales.seasonal_patterns),
    "category_supplier_efficiency": _tables(finance.category_supplier_efficiency, suppliers=True),
    "critical_products": _tables(stock.critical_products, suppliers=True),
    "top15_sales": _tables(sales.top15_sales),
    "enriched_inventory": _tables(frame.enriched_inventory, suppliers=True),
    "recent_movements": _tables(
        lambda t: frame.recent_movements(t).select(
            "movement_id", "product_id", "kind", "quantity", "moved_at"
        )
    ),
    "business_kpis": _selection(lambda df: _digits(kpis.business_kpis(df), "mean_turnover")),
    "dashboard_kpis": _selection(kpis.dashboard_kpis),
    "insights": _selection(kpis.insights),
    "critical_list": _selection(stock.critical_list, "categories", "suppliers"),
    "critical_summary": _selection(stock.critical_summary),
    "purchase_recommendations": _selection(stock.purchase_recommendations, "suppliers"),
    "purchase_total": _selection(stock.purchase_total),
    "trend_forecast": _selection(sales.trend_forecast),
    "trend_forecast_kpis": _selection(
        lambda df: _digits(sales.trend_forecast_kpis(df), "mean_growth_pct")),
    "category_trend": _selection(
        lambda df: _digits(sales.category_trend(df), "mean_growth_pct"), "categories"),
    "financial_kpis": _selection(finance.financial_kpis),
    "abc_filtered": _selection(
        lambda df: finance.abc_filtered(select.select_inventory(df, category="SMALL")),
        "categories",
    ),
    "abc_class_counts": _selection(finance.abc_class_counts),
    "abc_top_a": _selection(finance.abc_top_a),
    "category_summary": _selection(finance.category_summary, "categories"),
    "supplier_summary": _selection(finance.supplier_summary, "suppliers"),
    "full_inventory_report": _selection(stock.full_inventory_report, "categories", "suppliers"),
    "top20_sales_report": _selection(sales.top20_sales_report),
    "turnover_report": _selection(stock.turnover_report),
    "no_movement_report": _selection(stock.no_movement_report, "categories"),
    "no_movement_total": _selection(stock.no_movement_total),
    "margin_report": _selection(finance.margin_report),
    "margin_stats": _selection(finance.margin_stats),
    "stock_state_distribution": _selection(stock.stock_state_distribution),
    "selection_totals": _selection(stock.selection_totals),
    "run_report_suite": _suite,
}

# Tables, ledger and streams ------------------------------------------------


def _event_rows(events: DataFrame) -> DataFrame:
    return events.select(
        "ts", F.col("event_type").alias("kind"), F.col("value").alias("amount")
    )


# Files that the events are dealt to for a stream, at least, and rows of one at most; each is a
# micro-batch.
EVENT_FILES, EVENT_ROWS = 4, 250_000
#: Full files that a task writes of a large table: only its last one is a remainder.
TASK_FILES = 4


def _tasks(rows: DataFrame) -> int:
    """Tasks that deal the rows to files."""
    return max(EVENT_FILES, -(-rows.count() // (TASK_FILES * EVENT_ROWS)))


def _event_stream(spark: SparkSession, d: str, by: Column | None = None) -> DataFrame:
    """The events as a stream of bounded micro-batches, in sequence or dealt out by a column."""
    path = run_path(spark, "events")
    events = star.star_table(spark, d, "events")
    tasks = _tasks(events)
    if by is None:
        dealt = events.repartitionByRange(tasks, "event_id").sortWithinPartitions("event_id")
    else:
        dealt = events.repartition(tasks, by)
    dealt.write.option("maxRecordsPerFile", EVENT_ROWS).parquet(path)
    if by is None:
        live.date_by_name(spark, path)
    return live.file_stream(spark, path, star.STAR_SCHEMAS["events"], files_per_trigger=1)


def _crossings_stream(spark: SparkSession, d: str) -> DataFrame:
    """Readings arrive in sequence; the rows of a key in a micro-batch are as bounded as a file."""
    updates = star.as_stock_updates(_event_stream(spark, d))
    return live.run_to_files(crossings.crossing_alerts_stream(updates), "crossing-alerts")


#: Days by which readings are delayed at most, and by which a wholly random order may delay one.
DELAY_DAYS, SPAN_DAYS = 2, 60


def _late_events(spark: SparkSession, d: str, days: int) -> DataFrame:
    """The events as a stream in which each one arrives up to some days after its time.

    A last row without a user closes the stream: its time lies behind all lateness.
    """
    path = run_path(spark, "late-events")
    events = star.star_table(spark, d, "events")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(days * 86_400)).cast("int")
    arrival = F.col("ts") + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
    closing = events.agg((F.max("ts") + F.expr(f"INTERVAL '{2 * days + 1}' DAY")).alias("ts"))
    closing = closing.select("ts", *none).withColumn("_arrival", F.col("ts"))
    dealt = events.withColumn("_arrival", arrival).unionByName(closing)
    dealt = dealt.repartitionByRange(_tasks(events), "_arrival").sortWithinPartitions("_arrival")
    dealt.drop("_arrival").write.option("maxRecordsPerFile", EVENT_ROWS).parquet(path)
    live.date_by_name(spark, path)
    return live.file_stream(spark, path, star.STAR_SCHEMAS["events"], files_per_trigger=1)


def _reordered_stream(days: int) -> Query:
    """Readings arrive out of order by at most so many days, which the lateness allows."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        updates = star.as_stock_updates(_late_events(spark, d, days), "ts")
        found = reorder.reordered_alerts_stream(updates, lateness=f"{days} days")
        return live.run_to_files(found, "reordered-alerts")

    return run


def _live_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events arrive in any order, so the lateness spans all of them."""
    rows = _event_rows(_event_stream(spark, d, F.xxhash64("event_id")))
    keys = ("window_start", "window_end", "kind")
    return live.run_updates(live.live_kpis(rows, lateness="36500 days"), keys, "live-kpis")


def _settling_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events arrive up to two days late, the lateness is an hour: most sums need corrections."""
    rows = _event_rows(_late_events(spark, d, DELAY_DAYS)).where("kind IS NOT NULL")
    return settling.run_settling(rows, lateness="1 hour")[0]


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """Stock levels of the event readings applied to the snapshot."""
    readings = star.stock_updates(spark, d).select(
        "product_id", "seq", F.floor("level").cast("int").alias("stock")
    )
    after = snapshot.upsert_snapshot(
        star.products(spark, d, main_supplier=False), readings, now="2001-08-02 00:00:00"
    )
    return after.select("product_id", "name", "stock", "updated_at")


def _upserted_stream(run: Callable[..., DataFrame]) -> Query:
    """The same through a stream in any order; the last version of the snapshot."""
    def fold(spark: SparkSession, d: str) -> DataFrame:
        events = _event_stream(spark, d, F.xxhash64("event_id"))
        updates = star.as_stock_updates(events).select(
            "product_id", "seq", F.floor("level").cast("int").alias("stock")
        )
        after = run(
            star.products(spark, d, main_supplier=False), updates, now="2001-08-02 00:00:00")
        return after.select("product_id", "name", "stock", "updated_at")

    return fold


def _leveled(spark: SparkSession, d: str) -> DataFrame:
    """Ledger with levels from the running stock and every 1000th one wrong."""
    moved = ledger.apply_movements(star.movements(spark, d))
    wrong = F.when(F.col("movement_id") % 1000 == 0, 1).otherwise(0)
    return moved.withColumns({
        "stock_before": (F.col("stock") - ledger.signed_quantity()).cast("int"),
        "stock_after": (F.col("stock") + wrong).cast("int"),
    }).drop("stock")


def _on_hand_breaks(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger_breaks(_leveled(spark, d)).agg(F.count_if("wrong_sum").alias("wrong_sums"))


#: Days by which movements are delayed at most, of seven years of them.
MOVEMENT_DELAY_DAYS = 90


def _late_movements(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Movements as a stream in which each one arrives up to some days after its time."""
    path = run_path(spark, "late-movements")
    delay = F.pmod(F.xxhash64("movement_id"), F.lit(MOVEMENT_DELAY_DAYS * 86_400)).cast("int")
    arrival = F.col("moved_at") + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))
    rows = materialized(rows.withColumn("_arrival", arrival), "movements")
    dealt = rows.repartitionByRange(_tasks(rows), "_arrival").sortWithinPartitions("_arrival")
    dealt.drop("_arrival").write.option("maxRecordsPerFile", EVENT_ROWS).parquet(path)
    live.date_by_name(spark, path)
    return live.file_stream(spark, path, rows.drop("_arrival").schema, files_per_trigger=1)


def _settled_ledger(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The ledger that a stream of late movements ends with."""
    lateness = f"{MOVEMENT_DELAY_DAYS} days"
    changes = ledger_stream.ledger_changes_stream(_late_movements(spark, rows), lateness)
    return ledger_stream.settled(live.run_to_files(changes, "ledger-changes"))


def _applied_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = star.movements(spark, d).select("movement_id", "product_id", "kind", "quantity", "moved_at")
    return _settled_ledger(spark, rows).select(
        "movement_id", "product_id", "kind", F.col("quantity").cast("int").alias("quantity"),
        "moved_at", "stock")


def _breaks_stream(spark: SparkSession, d: str) -> DataFrame:
    return _settled_ledger(spark, _leveled(spark, d)).agg(F.count_if("wrong_sum").alias("wrong_sums"))


def _on_hand_stream(spark: SparkSession, d: str) -> DataFrame:
    """Net quantities per product as they stand when all movements have arrived."""
    rows = star.movements(spark, d).select("movement_id", "product_id", "kind", "quantity", "moved_at")
    sums = ledger.stock_on_hand(_late_movements(spark, rows))
    return live.run_updates(sums, ("product_id",), "on-hand")


MOVEMENTS: dict[str, Query] = {
    "table_stats": _tables(lambda t: sinks.table_stats(t.as_dict())),
    "check_integrity": _tables(
        lambda t: quality.check_integrity(t.as_dict()), suppliers=True
    ),
    "run_report_suite_shared": _suite_shared,
    "crossing_alerts": lambda spark, d: crossings.crossing_alerts(star.stock_updates(spark, d)),
    "crossing_alerts_split_keys": lambda spark, d: crossings.crossing_alerts(
        star.stock_updates(spark, d), hot_rows=50
    ),
    "crossing_alerts_stream": _crossings_stream,
    "crossing_alerts_reordered_stream": _reordered_stream(DELAY_DAYS),
    "crossing_alerts_shuffled_stream": _reordered_stream(SPAN_DAYS),
    "apply_movements": lambda spark, d: ledger.apply_movements(star.movements(spark, d)).select(
        "movement_id", "product_id", "kind", "quantity", "moved_at", "stock"
    ),
    "apply_movements_split_keys": lambda spark, d: ledger.apply_movements(
        star.movements(spark, d), hot_rows=30
    ).select("movement_id", "product_id", "kind", "quantity", "moved_at", "stock"),
    "ledger_breaks": _on_hand_breaks,
    "apply_movements_stream": _applied_stream,
    "ledger_breaks_stream": _breaks_stream,
    "stock_on_hand_stream": _on_hand_stream,
    "stock_on_hand": lambda spark, d: ledger.stock_on_hand(star.movements(spark, d)),
    "upsert_snapshot": _upserted,
    "upsert_snapshot_stream": _upserted_stream(snapshot.run_upsert),
    "upsert_snapshot_delta_stream": _upserted_stream(delta_runs.run_upsert),
    "live_kpis": lambda spark, d: live.live_kpis(_event_rows(star.star_table(spark, d, "events"))),
    "live_kpis_stream": _live_stream,
    "live_kpis_settling_stream": _settling_stream,
}

# Models --------------------------------------------------------------------

FEATURE_COLUMNS = (
    "price_ratio", "margin_abs", "turnover_year", "trend", "stock_sales_ratio",
    "category_code", "supplier_code", "days_since_sale", "seasonality",
)


def _forecast(spark: SparkSession, d: str, **options) -> forecast.Forecast:
    return forecast.forecast_demand(select.active(star.products(spark, d)), AS_OF, **options)


def _importance(spark: SparkSession, d: str) -> DataFrame:
    result = _forecast(spark, d, feature_cols=features.DEMAND_FEATURES)
    return forecast.feature_importance(result, spark)


def _clusters(spark: SparkSession, d: str) -> cluster.Clusters:
    t = star.star_tables(spark, d, main_supplier=False)
    return cluster.cluster_products(
        joins.join_dims(select.active(t.products), t.categories, how="left"), AS_OF
    )


def _scenarios(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = forecast.simulate_scenarios(
        select.active(star.products(spark, d)),
        {
            "base": {},
            "high_season": {"demand_multiplier": 1.5},
            "dearer": {"price_change": 0.1},
        },
        AS_OF,
    )
    return rows


def _recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Every part of the bundle, as rows per part."""
    t = star.star_tables(spark, d)
    products = joins.join_dims(select.active(t.products), t.categories, how="left")
    return sinks.table_stats(actions.recommendations(products, AS_OF)).withColumnsRenamed(
        {"table_name": "part", "live_rows": "rows"}
    )


MODELS: dict[str, Query] = {
    "build_features": lambda spark, d: features.build_features(
        star.products(spark, d), AS_OF
    ).select("product_id", *FEATURE_COLUMNS),
    "simple_forecast": _products(
        lambda p: forecast.simple_forecast(p, horizon_days=45)
    ),
    "forecast_demand": lambda spark, d: _forecast(spark, d).rows,
    "forecast_metrics": lambda spark, d: _forecast(
        spark, d, feature_cols=features.DEMAND_FEATURES
    ).metrics,
    "critical_actions": lambda spark, d: actions.critical_actions(_forecast(spark, d).rows),
    "feature_importance": _importance,
    "simulate_scenarios": _scenarios,
    "detect_anomalies": _products(lambda p: anomaly.detect_anomalies(select.active(p), AS_OF)),
    "cluster_products": lambda spark, d: _clusters(spark, d).rows,
    "cluster_stats": lambda spark, d: _clusters(spark, d).stats,
    "opportunities": lambda spark, d: actions.opportunities(_clusters(spark, d).rows),
    "recommendations": _recommendations,
}

# Days of sales history that a report looks back; the others need all of it.
LOOK_BACK: dict[int, tuple[str, ...]] = {
    30: (
        "view_profitability", "category_profitability", "category_profitability_brief",
        "top15_profitable", "inventory_turnover", "location_utilization", "executive_kpis",
        "abc_analysis", "abc_analysis_bucketed", "top15_sales", "with_margin", "with_revenue",
        "with_turnover", "with_months_of_stock", "with_annual_turnover", "with_days_of_stock",
        "with_reorder_qty", "stock_state4", "stock_state4_icon", "stock_state3",
        "turnover_class_annual", "turnover_class_months", "reorder_priority", "active",
        "critical", "slow_moving", "location_left_join", "quantiles", "global_rank",
        "global_row_number", "running_total", "distributed_prefix", "quintile_label", "quantiles_by_selection",
    ),
    60: (
        "sales_projection", "monthly_comparison", "business_kpis", "dashboard_kpis", "insights",
        "critical_summary", "purchase_total", "trend_forecast", "trend_forecast_kpis",
        "category_trend", "financial_kpis", "abc_filtered", "abc_class_counts", "abc_top_a",
        "category_summary", "top20_sales_report", "turnover_report", "no_movement_total",
        "margin_report", "margin_stats", "stock_state_distribution", "selection_totals",
        "with_growth", "with_projection", "with_suggested_purchase", "future_stock_risk",
        "stockout_risk", "notable_forecasts", "value_counts", "mean_turnover", "with_totals",
        "top_k",
    ),
    90: (
        "anomaly_kind",
    ),
    365: (
        "view_top_products", "view_top_products_bucketed", "seasonal_patterns", "with_averages",
        "season_class",
    ),
}

QUERIES: dict[str, Query] = {
    **REPORTS, **MEASURES, **CLASSES, **OPERATORS, **MOVEMENTS, **MODELS
}


def _with_folder(query: Query) -> Query:
    """The query, with a folder for intermediate files where a local session names none."""
    def run(spark: SparkSession, directory: str) -> DataFrame:
        context = spark.sparkContext
        unset = spark.conf.get(SETTING, None) is None and context.getCheckpointDir() is None
        if unset and context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="stocklens-"))
        return query(spark, directory)

    return run


QUERIES |= {name: replace(QUERIES[name], days=days)
            for days, names in LOOK_BACK.items() for name in names}
QUERIES |= {name: _with_folder(QUERIES[name]) for name in (*MOVEMENTS, *MODELS)}
