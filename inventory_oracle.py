"""The same queries as SQL over the star-schema tables, for comparison.

``WITH_TABLES`` defines the inventory tables; every query continues it.
Half-up rounding goes through DECIMAL, since the rounded values are decimal
quantities: 23 / 40 rounds to 0.58, while binary 0.575 would give 0.57.
"""

from __future__ import annotations

from stocklens.functions import labels as L

DAY = "DATE '2001-08-01'"

WITH_TABLES = f"""
WITH shipped AS (
  SELECT l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, CAST(l_shipdate AS DATE) AS day
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-01'
), delivered AS (
  SELECT part, supp, row_number() OVER (PARTITION BY part ORDER BY sum(qty) DESC, supp) AS place
  FROM shipped GROUP BY part, supp
), counters AS (
  SELECT part,
    CAST(sum(CASE WHEN day > {DAY} - 30 THEN qty ELSE 0 END) AS INT) AS m0,
    CAST(sum(CASE WHEN day > {DAY} - 60 AND day <= {DAY} - 30 THEN qty ELSE 0 END) AS INT) AS m1,
    CAST(sum(CASE WHEN day > {DAY} - 90 THEN qty ELSE 0 END) AS INT) AS q,
    CAST(sum(CASE WHEN day > {DAY} - 365 THEN qty ELSE 0 END) AS INT) AS y,
    max(day) AS last_sale
  FROM shipped GROUP BY part
), cents AS (
  SELECT *, CAST(round(p_retailprice * 100, 0) AS BIGINT) * (55 + p_size % 30) AS scaled FROM part
), every_product AS (
  SELECT p_partkey AS product_id, p_name AS name,
    ('0x' || substr(md5(p_type), 1, 15))::BIGINT AS category_id,
    d.supp AS supplier_id, CAST(substring(p_brand, 7) AS INT) AS location_id,
    CAST(CASE WHEN p_partkey % 20 = 0 THEN 0 ELSE p_size END AS INT) AS stock,
    5 AS min_stock, 10 AS reorder_point, 100 AS max_stock,
    CAST(CAST(scaled - scaled % 100 AS DECIMAL(14,0)) * CAST('0.0001' AS DECIMAL(5,4))
      AS DECIMAL(10,2)) AS unit_cost,
    CAST(p_retailprice AS DECIMAL(10,2)) AS price,
    coalesce(m0, 0) AS sales_month, coalesce(m1, 0) AS sales_prev_month,
    coalesce(q, 0) AS sales_quarter, coalesce(y, 0) AS sales_year, c.last_sale,
    p_partkey % 50 <> 7 AS active
  FROM cents LEFT JOIN counters c ON c.part = p_partkey
  LEFT JOIN delivered d ON d.part = p_partkey AND d.place = 1
), cat AS (
  SELECT DISTINCT p_type AS category,
    ('0x' || substr(md5(p_type), 1, 15))::BIGINT AS category_id
  FROM part
), sup AS (
  SELECT s_suppkey AS supplier_id, s_name AS supplier, CAST(2 + s_suppkey % 9 AS INT) AS lead_days,
    CAST(CAST(30 + s_suppkey % 20 AS DECIMAL(3,0)) * CAST('0.1' AS DECIMAL(2,1)) AS DECIMAL(3,2))
      AS rating,
    s_suppkey % 10 <> 3 AS supplier_active
  FROM supplier
), numbers AS (
  SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) AS n FROM part UNION SELECT 0
), loc AS (
  SELECT n AS location_id, 'B' AS section, CAST(n AS VARCHAR) AS aisle,
    CASE WHEN n % 5 <> 0 THEN 'E' || (n % 5) END AS shelf, CAST(n % 3 AS VARCHAR) AS level,
    2000 AS capacity, CAST(NULL AS VARCHAR) AS description
  FROM numbers
), allp AS (
  SELECT *,
    CAST(price - unit_cost AS DECIMAL(18,2)) AS unit_profit,
    CASE WHEN price <> 0
      THEN CAST((price - unit_cost) * 100 AS DOUBLE) / CAST(price AS DOUBLE) END AS margin,
    CASE WHEN price <> 0
      THEN CAST(price - unit_cost AS DOUBLE) / CAST(price AS DOUBLE) * 100.0 END AS margin_float,
    CAST((price - unit_cost) * sales_month AS DECIMAL(18,2)) AS profit_month,
    CAST(price * sales_month AS DECIMAL(18,2)) AS revenue_month,
    CAST(price * sales_prev_month AS DECIMAL(18,2)) AS revenue_prev_month,
    CAST(unit_cost * sales_month AS DECIMAL(18,2)) AS cost_month,
    CAST(unit_cost * stock AS DECIMAL(18,2)) AS stock_value,
    CASE WHEN sales_prev_month > 0
      THEN CAST(sales_month - sales_prev_month AS DOUBLE) / sales_prev_month ELSE 0.0 END AS growth,
    CASE WHEN sales_prev_month > 0
      THEN CAST(100 * (sales_month - sales_prev_month) AS DOUBLE) / sales_prev_month ELSE 0.0 END
      AS growth_exact,
    CASE WHEN stock > 0 THEN CAST(sales_month AS DOUBLE) / stock ELSE 0.0 END AS turnover_month,
    CASE WHEN sales_month > 0 THEN CAST(stock AS DOUBLE) / sales_month END AS months,
    date_diff('day', last_sale, {DAY}) AS idle_days
  FROM every_product
), inv AS (
  SELECT * FROM allp WHERE active
), frame AS (
  SELECT inv.*, round_even(margin_float, 2) AS margin_pct, growth * 100.0 AS growth_pct,
    category, supplier, lead_days, rating,
    CASE WHEN stock = 0 THEN '{L.STATE_ICON[0]}' WHEN stock <= min_stock THEN '{L.STATE_ICON[1]}'
      WHEN stock <= reorder_point THEN '{L.STATE_ICON[2]}' ELSE '{L.STATE_ICON[3]}' END
      AS stock_state,
    CAST(CASE WHEN sales_prev_month > 0
      THEN round_even(CAST(sales_month AS DOUBLE) * sales_month / sales_prev_month, 0)
      ELSE sales_month END AS BIGINT) AS projection
  FROM inv LEFT JOIN cat USING (category_id) LEFT JOIN sup USING (supplier_id)
)
"""


def _up(value: str, digits: int = 2) -> str:
    """A double rounded half away from zero in decimal."""
    return f"CAST(round(CAST({value} AS DECIMAL(28,12)), {digits}) AS DOUBLE)"


def _case(pairs, otherwise) -> str:
    """A CASE over (condition, label) pairs."""
    arms = " ".join(f"WHEN {c} THEN '{label}'" for c, label in pairs)
    return f"CASE {arms} ELSE '{otherwise}' END"


def _state4(labels) -> str:
    limits = ("stock = 0", "stock <= min_stock", "stock <= reorder_point")
    return _case(zip(limits, labels), labels[3])


def _state3(labels) -> str:
    return _case(zip(("stock <= min_stock", "stock <= reorder_point"), labels), labels[2])


def _cover(demand: str, labels) -> str:
    rules = (f"stock < {demand}", f"2 * stock < 3 * {demand}")
    return _case(zip(rules, labels), labels[2])


def _abc(share: str, labels) -> str:
    return _case(zip((f"{share} <= 80", f"{share} <= 95"), labels), labels[2])


UP = """CAST(CASE WHEN sales_prev_month > 0
  THEN round(CAST(sales_month AS DOUBLE) * sales_month / sales_prev_month)
  ELSE sales_month END AS BIGINT)"""
EVEN = UP.replace("round(", "round_even(").replace("sales_prev_month)\n", "sales_prev_month, 0)\n")
TURNS = "CASE WHEN stock > 0 AND sales_month > 0 THEN CAST(12 * sales_month AS DOUBLE) / stock ELSE 0.0 END"
SEASON = _case(
    (("sales_month * 8 > sales_year", L.SEASON_PEAK[0]),
     ("sales_month * 24 < sales_year", L.SEASON_VALLEY[0])), L.SEASON_NORMAL[0])
ADVICE = _case(
    (("sales_month * 8 > sales_year", L.SEASON_PEAK[1]),
     ("sales_month * 24 < sales_year", L.SEASON_VALLEY[1])), L.SEASON_NORMAL[1])
REORDER_PRIORITY = _case(
    (("stock = 0", L.PRIORITIES[0]), ("stock <= round(min_stock * 0.5)", L.PRIORITIES[1])),
    L.PRIORITIES[2])
IDLE_PRIORITY = _case(
    (("idle_days > 90", L.PRIORITIES[1]), ("idle_days > 60", L.PRIORITIES[2])), L.PRIORITIES[3])
TURNOVER_YEAR = _case(
    [*[(f"turns >= {n}", label) for n, label in L.TURNOVER_YEAR], ("turns > 0", L.TURNOVER_YEAR_SLOW)],
    L.TURNOVER_YEAR_NONE)
TURNOVER_MONTHS = _case(
    [(f"m < {n}", label) for n, label in L.TURNOVER_MONTHS], L.TURNOVER_MONTHS_SLOW)
ANOMALY = _case((
    ("NOT odd", L.ANOMALY_NONE),
    ("sales_month > 3 * sales_prev_month", L.ANOMALY_PEAK),
    ("sales_prev_month > 0 AND 10 * sales_month < 3 * sales_prev_month", L.ANOMALY_DROP),
    ("stock > 6 * sales_month", L.ANOMALY_OVERSTOCK)), L.ANOMALY_OTHER)

MONEY = "DECIMAL(18,2)"


def _sum(col: str, name: str) -> str:
    return f"CAST(sum({col}) AS {MONEY}) AS {name}"


def _units(col: str, name: str) -> str:
    return f"CAST(sum({col}) AS BIGINT) AS {name}"


CRITICAL = "count(*) FILTER (WHERE stock <= min_stock)"
EXACT_MEAN = "CAST(sum(CAST(margin_pct AS DECIMAL(18,2))) AS DOUBLE) / count(margin_pct)"
NET = """CASE WHEN revenue_month > 0
  THEN CAST(revenue_month - cost_month AS DOUBLE) / CAST(revenue_month AS DOUBLE) * 100.0
  ELSE 0.0 END"""
KPIS = f"""
SELECT *, CAST(revenue_month - cost_month AS {MONEY}) AS profit_month,
  coalesce(CAST(critical_products AS DOUBLE) / products * 100.0, 0.0) AS critical_pct,
  {NET} AS net_margin_pct
FROM (SELECT count(*) AS products, count(*) FILTER (WHERE active) AS active_products,
  {CRITICAL} AS critical_products, {_sum('stock_value', 'stock_value')},
  {_sum('revenue_month', 'revenue_month')}, {_sum('cost_month', 'cost_month')},
  {EXACT_MEAN} AS mean_margin_pct,
  coalesce(avg(turnover_month) FILTER (WHERE turnover_month > 0), 0.0) AS mean_turnover,
  count(*) FILTER (WHERE sales_month = 0) AS no_sales_products FROM frame)"""


def _insight(condition: str, insight, value: str | None) -> str:
    kind, title, message, priority = insight
    text = f"'{message.replace('%%', '%')}'"
    if value is not None:
        text = f"replace({text}, '%s', {value})"
    return (
        f"SELECT '{kind}' AS kind, '{title}' AS title, {text} AS message, "
        f"'{priority}' AS priority, {{n}} AS rule FROM k WHERE {condition}"
    )


_RULES = [
    _insight("critical_pct > 15", L.INSIGHT_CRITICAL, "printf('%.1f', critical_pct)"),
    _insight("net_margin_pct < 20", L.INSIGHT_LOW_MARGIN, "printf('%.1f', net_margin_pct)"),
    _insight("net_margin_pct > 35", L.INSIGHT_HIGH_MARGIN, "printf('%.1f', net_margin_pct)"),
    _insight("mean_turnover < 0.5", L.INSIGHT_LOW_TURNOVER, None),
    _insight("no_sales_products > 0.2 * products", L.INSIGHT_NO_SALES,
             "CAST(no_sales_products AS VARCHAR)"),
    _insight("growing > 0", L.INSIGHT_GROWTH, "CAST(growing AS VARCHAR)"),
]
INSIGHTS = f"""
, k AS (SELECT *, (SELECT count(*) FROM frame WHERE growth_pct > 50) AS growing FROM ({KPIS}))
SELECT CAST(row_number() OVER (ORDER BY rule) - 1 AS INT) AS position, kind, title, message, priority
FROM ({' UNION ALL '.join(r.format(n=i) for i, r in enumerate(_RULES))})"""

ALERTS = f"""
SELECT '{L.ALERT_REORDER}' AS alert_kind, product_id, name,
  'Stock bajo: ' || stock || ' unidades (mínimo: ' || min_stock || ')' AS message,
  {REORDER_PRIORITY} AS priority, supplier, lead_days,
  CAST((reorder_point - stock) * unit_cost AS {MONEY}) AS investment, {DAY} AS raised_on
FROM inv JOIN sup USING (supplier_id) WHERE stock <= min_stock
UNION ALL
SELECT '{L.ALERT_IDLE}', product_id, name, 'Producto sin ventas por ' || idle_days || ' días',
  {IDLE_PRIORITY}, supplier, NULL, stock_value, {DAY}
FROM inv JOIN sup USING (supplier_id) WHERE last_sale < {DAY} - 45 AND stock > 0"""

ABC_RANKED = """
, revenue AS (SELECT *, row_number() OVER (ORDER BY revenue_month DESC, product_id) AS rank,
    sum(revenue_month) OVER (ORDER BY revenue_month DESC, product_id
      ROWS UNBOUNDED PRECEDING) AS running, sum(revenue_month) OVER () AS total
  FROM frame WHERE sales_month > 0 {where}
), shares AS (
  SELECT *, CAST(running AS DOUBLE) / CAST(total AS DOUBLE) * 100.0 AS share,
    CAST(100 * running AS DOUBLE) / CAST(total AS DOUBLE) AS share_exact FROM revenue
)"""
ABC_ALL = ABC_RANKED.format(where="")
ABC_FULL = ABC_ALL + f"""
SELECT product_id, name, category, rank, revenue_month, cumulative_pct,
  {_abc('cumulative_pct', L.ABC_FULL)} AS abc_class
FROM (SELECT *, {_up("share_exact")} AS cumulative_pct FROM shares)"""

TOP_PRODUCTS = """
SELECT product_id, name, category, sales_month, sales_quarter, sales_year, profit_month, stock,
  rank() OVER (ORDER BY sales_month DESC) AS rank_sales,
  rank() OVER (ORDER BY profit_month DESC) AS rank_profit
FROM inv LEFT JOIN cat USING (category_id) WHERE sales_month > 0"""

CATEGORY = f"""
SELECT category_id, category, count(*) AS products, {_units('stock', 'stock')},
  {_up("avg(margin)")} AS mean_margin_pct, {_sum('stock_value', 'stock_value')},
  {_sum('profit_month', 'profit_month')}, {_sum('revenue_month', 'revenue_month')} {{more}}
FROM inv JOIN cat USING (category_id) GROUP BY category_id, category"""


def _summary(key: str) -> str:
    return f"""
SELECT {key}, {_units('sales_month', 'units_month')}, {_sum('profit_month', 'profit_month')},
  {_sum('stock_value', 'stock_value')}, count(*) AS products,
  round_even(avg(margin_pct), 2) AS mean_margin_pct
FROM frame WHERE {key} IS NOT NULL GROUP BY {key}"""


REPORTS = {
    "view_critical_stock": f"""
SELECT product_id, name, category, stock, min_stock, reorder_point, supplier, lead_days,
  sales_month, {_state4(L.STATE_PLAIN)} AS stock_state
FROM inv LEFT JOIN cat USING (category_id) LEFT JOIN sup USING (supplier_id)""",
    "view_profitability": f"""
SELECT product_id, name, category, unit_cost, price, unit_profit, {_up("margin")} AS margin_pct,
  sales_month, profit_month, stock_value, {_up("months")} AS months_of_stock
FROM inv LEFT JOIN cat USING (category_id)""",
    "view_top_products": TOP_PRODUCTS,
    "view_top_products_bucketed": TOP_PRODUCTS,
    "register_views": """
SELECT category, count(*) AS products, CAST(sum(profit_month) AS DECIMAL(28,2)) AS profit_month
FROM inv LEFT JOIN cat USING (category_id) GROUP BY category""",
    "top10_sales": f"""
SELECT product_id, name, category, supplier, sales_month, stock, profit_month,
  {_state3(L.STATE3_ICON)} AS stock_state
FROM inv JOIN cat USING (category_id) JOIN sup USING (supplier_id)
ORDER BY sales_month DESC, product_id LIMIT 10""",
    "urgent_reorder": f"""
SELECT product_id, name, category, stock, min_stock, reorder_point, sales_month, supplier,
  lead_days, {_up("CAST(30 * stock AS DOUBLE) / nullif(sales_month, 0)", 1)} AS days_of_stock,
  reorder_point - stock AS reorder_qty,
  CAST((reorder_point - stock) * unit_cost AS {MONEY}) AS investment
FROM inv JOIN cat USING (category_id) JOIN sup USING (supplier_id) WHERE stock <= min_stock""",
    "category_profitability": CATEGORY.format(more=", " + _units("sales_month", "units_month")),
    "category_profitability_brief": CATEGORY.format(more=""),
    "top15_profitable": f"""
SELECT product_id, name, category, unit_cost, price, unit_profit, {_up("margin")} AS margin_pct,
  sales_month, profit_month, revenue_month
FROM inv JOIN cat USING (category_id) WHERE sales_month > 0
ORDER BY profit_month DESC, product_id LIMIT 15""",
    "supplier_performance": f"""
SELECT supplier_id, supplier, rating AS supplier_rating, lead_days,
  count(product_id) AS products, {_units('stock', 'stock')}, {_sum('stock_value', 'stock_value')},
  {_sum('revenue_month', 'revenue_month')}, {_up("avg(margin)")} AS mean_margin_pct,
  {CRITICAL} AS critical_products
FROM sup JOIN inv USING (supplier_id) GROUP BY supplier_id, supplier, rating, lead_days""",
    "inventory_turnover": f"""
SELECT product_id, name, category, stock, sales_month, unit_cost,
  CASE WHEN stock > 0 THEN {_up("months")} END AS months_of_stock, turns AS turnover_year,
  stock_value, {TURNOVER_YEAR} AS turnover_class
FROM (SELECT *, {_up(TURNS)} AS turns FROM inv) JOIN cat USING (category_id)""",
    "slow_movers": f"""
SELECT product_id, name, category, stock, sales_month, sales_quarter, last_sale,
  CAST(idle_days AS INT) AS idle_days, stock_value AS tied_up_value,
  CAST(round(price * CAST('0.7' AS DECIMAL(2,1)), 2) AS {MONEY}) AS clearance_price
FROM inv JOIN cat USING (category_id)
WHERE (sales_month <= 2 OR last_sale < {DAY} - 60) AND stock > 5""",
    "location_utilization": f"""
SELECT location_id, concat(section, '-', aisle, '-', shelf, '-', level) AS location_code,
  capacity, count(product_id) AS products, {_units('stock', 'units')},
  {_up("CAST(100 * sum(stock) AS DOUBLE) / capacity")} AS occupancy_pct,
  {_sum('stock_value', 'value')}, description
FROM loc LEFT JOIN inv USING (location_id)
GROUP BY location_id, section, aisle, shelf, level, capacity, description""",
    "sales_projection": f"""
SELECT product_id, name, category, sales_month, sales_prev_month,
  {_up("growth_exact")} AS growth_pct, next AS projection, stock, reorder_point,
  {_cover('next', L.FUTURE_STOCK)} AS future_stock,
  greatest(0, next - stock) AS suggested_purchase
FROM (SELECT *, {UP} AS next FROM inv) JOIN cat USING (category_id)""",
    "executive_kpis": f"""
SELECT '{L.SUMMARY_TITLE}' AS section, count(*) AS products,
  count(*) FILTER (WHERE stock > 0) AS in_stock, {CRITICAL} AS critical_products,
  {_sum('stock_value', 'stock_value')}, {_sum('revenue_month', 'revenue_month')},
  {_sum('profit_month', 'profit_month')}, {_up("avg(margin)")} AS mean_margin_pct,
  {_units('sales_month', 'units_month')} FROM inv""",
    "abc_analysis": ABC_FULL,
    "abc_analysis_bucketed": ABC_FULL,
    "auto_alerts": ALERTS,
    "monthly_comparison": f"""
SELECT '{L.MONTHLY_TITLE}' AS period, *,
  {_up("CAST(100 * (units_month - units_prev_month) AS DOUBLE) / nullif(units_prev_month, 0)")}
    AS units_growth_pct,
  {_up("CAST(100 * (revenue_month - revenue_prev_month) AS DOUBLE)"
       " / nullif(CAST(revenue_prev_month AS DOUBLE), 0)")} AS revenue_growth_pct
FROM (SELECT {_units('sales_month', 'units_month')}, {_units('sales_prev_month', 'units_prev_month')},
  {_sum('revenue_month', 'revenue_month')}, {_sum('revenue_prev_month', 'revenue_prev_month')}
  FROM inv)""",
    "seasonal_patterns": f"""
SELECT product_id, name, category, sales_month, sales_prev_month, sales_quarter, sales_year,
  {_up("CAST(sales_quarter AS DOUBLE) / 3.0")} AS avg_quarter,
  {_up("CAST(sales_year AS DOUBLE) / 12.0")} AS avg_year, {SEASON} AS season, {ADVICE} AS advice
FROM inv JOIN cat USING (category_id) WHERE sales_year > 0""",
    "category_supplier_efficiency": f"""
SELECT category, supplier, rating AS supplier_rating, lead_days,
  count(product_id) AS products, {_up("avg(sales_month)")} AS mean_sales,
  {_up("avg(margin)")} AS mean_margin_pct, {_sum('stock_value', 'tied_up_value')},
  {CRITICAL} AS critical_products,
  {_up(f"CAST(100 * {CRITICAL} AS DOUBLE) / count(*)")} AS critical_pct
FROM inv JOIN cat USING (category_id) JOIN sup USING (supplier_id)
GROUP BY category, supplier, rating, lead_days""",
    "critical_products": f"""
SELECT product_id, name, category, stock, min_stock, sales_month, supplier,
  {_state4(L.STATE_PLAIN)} AS stock_state
FROM inv LEFT JOIN cat USING (category_id) LEFT JOIN sup USING (supplier_id)
WHERE stock <= min_stock""",
    "top15_sales": f"""
SELECT product_id, name, category, sales_month, stock, profit_month,
  {_state3(L.STATE3_PLAIN)} AS stock_state
FROM inv JOIN cat USING (category_id) ORDER BY sales_month DESC, product_id LIMIT 15""",
    "enriched_inventory": """
SELECT product_id, name, CAST(NULL AS VARCHAR) AS description, category_id, supplier_id,
  location_id, stock, min_stock, max_stock, reorder_point, unit_cost, price,
  CAST(NULL AS DECIMAL(10,2)) AS wholesale_price, 'GTQ' AS currency, sales_month,
  sales_prev_month, sales_quarter, sales_year, CAST(NULL AS DATE) AS last_purchase, last_sale,
  CAST(NULL AS DATE) AS expires_on, TIMESTAMP '2001-08-01' AS created_at,
  TIMESTAMP '2001-08-01' AS updated_at, CAST(NULL AS VARCHAR) AS barcode, 'pieza' AS unit,
  CAST(NULL AS DECIMAL(8,3)) AS weight_kg, CAST(NULL AS VARCHAR) AS dimensions,
  CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS model, 0 AS warranty_months,
  FALSE AS refrigerated, FALSE AS hazardous, active, category,
  CAST('0.30' AS DECIMAL(5,2)) AS category_margin, supplier, rating AS supplier_rating, lead_days,
  section || '-' || aisle || '-' || shelf AS location_code, loc.description AS location_description
FROM inv LEFT JOIN cat USING (category_id) LEFT JOIN sup USING (supplier_id)
LEFT JOIN loc USING (location_id)""",
    "recent_movements": """
SELECT l_orderkey * 10 + l_linenumber AS movement_id, l_partkey AS product_id,
  CASE WHEN l_returnflag = 'R' THEN 'ENTRADA' ELSE 'SALIDA' END AS kind,
  CAST(l_quantity AS INT) AS quantity, l_shipdate AS moved_at
FROM lineitem ORDER BY l_shipdate DESC, 1, 2, 3, 4 LIMIT 100""",
    "business_kpis": f"SELECT * REPLACE (round(mean_turnover, 6) AS mean_turnover) FROM ({KPIS})",
    "dashboard_kpis": f"""
SELECT products, active_products, critical_products, stock_value, revenue_month, profit_month,
  mean_margin_pct, critical_pct FROM ({KPIS})""",
    "insights": INSIGHTS,
    "critical_list": f"""
SELECT product_id, name, category, stock, min_stock, sales_month, supplier, stock_state,
  CASE WHEN sales_month > 0 THEN printf('%.1f', round_even(months * 30.0, 1))
    ELSE '{L.NO_SALES}' END AS days_of_stock
FROM frame WHERE stock <= min_stock""",
    "critical_summary": f"""
SELECT count(*) FILTER (WHERE stock_state = '{L.STATE_ICON[0]}') AS out_of_stock,
  count(*) FILTER (WHERE stock_state = '{L.STATE_ICON[1]}') AS critical,
  {_sum('stock_value', 'value_at_risk')} FROM frame WHERE stock <= min_stock""",
    "purchase_recommendations": f"""
SELECT product_id, name, supplier, reorder_point - stock AS reorder_qty, unit_cost,
  CAST((reorder_point - stock) * unit_cost AS {MONEY}) AS investment
FROM frame WHERE stock <= min_stock""",
    "purchase_total": f"""
SELECT {_sum('(reorder_point - stock) * unit_cost', 'investment')} FROM inv
WHERE stock <= min_stock""",
    "trend_forecast": f"""
SELECT product_id, name, sales_month, sales_prev_month, growth_pct, projection, stock,
  {_cover('projection', L.FUTURE_STOCK)} AS risk,
  greatest(0, projection - stock) AS suggested_purchase
FROM frame WHERE sales_month > 0 AND (projection > stock OR abs(growth_pct) > 10)""",
    "trend_forecast_kpis": f"""
SELECT count(*) FILTER (WHERE stock < projection) AS at_risk,
  round(avg(growth_pct), 6) AS mean_growth_pct,
  {_units('greatest(0, projection - stock)', 'suggested_purchase')} FROM frame""",
    "category_trend": f"""
SELECT category, {_units('sales_month', 'units_month')},
  {_units('sales_prev_month', 'units_prev_month')}, round(avg(growth_pct), 6) AS mean_growth_pct
FROM frame WHERE category IS NOT NULL GROUP BY category""",
    "financial_kpis": f"""
SELECT *, CAST(revenue_month - cost_month AS {MONEY}) AS profit_month, {NET} AS net_margin_pct
FROM (SELECT {_sum('revenue_month', 'revenue_month')}, {_sum('cost_month', 'cost_month')} FROM inv)""",
    "abc_filtered": ABC_RANKED.format(where="AND category = 'SMALL'") + f"""
SELECT product_id, name, rank, revenue_month, CAST(running AS DECIMAL(28,2)) AS cumulative_revenue,
  share AS cumulative_pct, {_abc('share', L.ABC_SELECTION)} AS abc_class FROM shares""",
    "abc_class_counts": ABC_ALL + f"""
SELECT {_abc('share', L.ABC_SELECTION)} AS abc_class, count(*) AS products FROM shares GROUP BY 1""",
    "abc_top_a": ABC_ALL + """
SELECT product_id, name, revenue_month, margin_pct FROM shares WHERE share <= 80
ORDER BY rank LIMIT 10""",
    "category_summary": _summary("category"),
    "supplier_summary": _summary("supplier"),
    "full_inventory_report": """
SELECT product_id, name, category, stock, min_stock, price, unit_cost, margin_pct, sales_month,
  stock_value, stock_state, supplier FROM frame""",
    "top20_sales_report": """
SELECT product_id, name, sales_month, sales_prev_month, profit_month, stock, turnover_month
FROM frame ORDER BY sales_month DESC, product_id LIMIT 20""",
    "turnover_report": f"""
SELECT product_id, name, sales_month, stock, m AS months_of_stock,
  {TURNOVER_MONTHS} AS turnover_class, stock_value
FROM (SELECT *, months AS m FROM frame WHERE sales_month > 0)""",
    "no_movement_report": """
SELECT product_id, name, category, stock, sales_month, sales_quarter,
  stock_value AS tied_up_value, last_sale FROM frame WHERE sales_month <= 2""",
    "no_movement_total": f"""
SELECT {_sum('stock_value', 'tied_up_value')} FROM inv WHERE sales_month <= 2""",
    "margin_report": """
SELECT product_id, name, unit_cost, price, unit_profit, margin_pct, sales_month, profit_month
FROM frame""",
    "margin_stats": f"""
SELECT {EXACT_MEAN} AS mean_margin_pct, max(margin_pct) AS max_margin_pct,
  min(margin_pct) AS min_margin_pct FROM frame""",
    "stock_state_distribution": "SELECT stock_state, count(*) AS products FROM frame GROUP BY 1",
    "selection_totals": f"""
SELECT {_sum('stock_value', 'stock_value')}, count(*) FILTER (WHERE active) AS active_products
FROM frame""",
    "run_report_suite": """
SELECT 'critical_products' AS report, count(*) AS rows FROM inv WHERE stock <= min_stock
UNION ALL SELECT 'top15_sales', least(15, count(*)) FROM inv
UNION ALL SELECT 'category_profitability', count(DISTINCT category_id) FROM inv
UNION ALL SELECT 'executive_kpis', 1""",
}

MEASURES = {
    "with_margin": f"""
SELECT product_id, unit_profit, {_up("margin")} AS margin_pct, profit_month, stock_value FROM allp""",
    "with_revenue": "SELECT product_id, revenue_month, cost_month FROM allp",
    "with_turnover": "SELECT product_id, turnover_month FROM allp",
    "with_months_of_stock": """
SELECT product_id, months AS months_or_null, CASE WHEN stock > 0 THEN months END AS months_strict,
  coalesce(months, 999.0) AS months_or_999 FROM allp""",
    "with_annual_turnover": f"""
SELECT product_id, {_up(TURNS)} AS turnover_rounded, {TURNS} AS turnover_raw FROM allp""",
    "with_days_of_stock": f"""
SELECT product_id, {_up("CAST(30 * stock AS DOUBLE) / nullif(sales_month, 0)", 1)} AS days,
  CASE WHEN sales_month > 0 THEN printf('%.1f', round_even(months * 30.0, 1))
    ELSE '{L.NO_SALES}' END AS days_text FROM allp""",
    "with_growth": f"""
SELECT product_id, growth AS fraction, {_up("growth_exact")} AS pct FROM allp""",
    "with_projection": f"SELECT product_id, {UP} AS half_up, {EVEN} AS half_even FROM allp",
    "with_reorder_qty": f"""
SELECT product_id, reorder_point - stock AS reorder_qty,
  CAST((reorder_point - stock) * unit_cost AS {MONEY}) AS investment FROM allp""",
    "with_suggested_purchase": f"""
SELECT product_id, greatest(0, {UP} - stock) AS suggested_purchase FROM allp""",
    "with_idle": f"""
SELECT product_id, CAST(idle_days AS INT) AS idle_days, stock_value AS tied_up_value,
  CAST(round(price * CAST('0.7' AS DECIMAL(2,1)), 2) AS {MONEY}) AS clearance_price FROM allp""",
    "with_averages": f"""
SELECT product_id, {_up("CAST(sales_quarter AS DOUBLE) / 3.0")} AS avg_quarter,
  {_up("CAST(sales_year AS DOUBLE) / 12.0")} AS avg_year FROM allp""",
    "location_code": """
SELECT location_id, concat(section, '-', aisle, '-', shelf, '-', level) AS four_parts,
  section || '-' || aisle || '-' || shelf AS three_parts FROM loc""",
}


def _labelled(expression: str, source: str = "allp") -> str:
    return f"SELECT product_id, {expression} AS label FROM {source}"


CLASSES = {
    "stock_state4": _labelled(_state4(L.STATE_PLAIN)),
    "stock_state4_icon": _labelled(_state4(L.STATE_ICON)),
    "stock_state3": _labelled(_state3(L.STATE3_ICON)),
    "turnover_class_annual": _labelled(
        TURNOVER_YEAR, f"(SELECT *, {_up(TURNS)} AS turns FROM allp)"),
    "turnover_class_months": _labelled(
        TURNOVER_MONTHS, "(SELECT *, coalesce(months, 999.0) AS m FROM allp)"),
    "season_class": _labelled(SEASON),
    "future_stock_risk": _labelled(
        _cover("next", L.FUTURE_STOCK), f"(SELECT *, {UP} AS next FROM allp)"),
    "stockout_risk": _labelled(
        _cover("next", L.STOCKOUT), f"(SELECT *, {EVEN} AS next FROM allp)"),
    "reorder_priority": _labelled(REORDER_PRIORITY),
    "idle_priority": _labelled(IDLE_PRIORITY),
    "anomaly_kind": _labelled(ANOMALY, "(SELECT *, sales_quarter > 100 AS odd FROM allp)"),
}

_RANKS = """
SELECT product_id, sales_month,
  rank() OVER (ORDER BY sales_month DESC) AS rank,
  row_number() OVER (ORDER BY sales_month DESC, product_id) AS row_number,
  CAST(sum(sales_month) OVER (ORDER BY sales_month DESC, product_id ROWS UNBOUNDED PRECEDING)
    AS BIGINT) AS running
FROM allp"""
_SOLD_RANKS = f"({_RANKS} WHERE sales_month > 0)"
_QUANTILES = " UNION ALL ".join(
    f"SELECT '{c}' AS measure, {p} AS probability, q AS plain, q AS bucketed "
    f"FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), {p}) AS q FROM allp)"
    for c in ("sales_month", "stock") for p in ("0.3::DOUBLE", "0.7::DOUBLE", "0.8::DOUBLE")
)

OPERATORS = {
    "active": "SELECT product_id FROM inv",
    "select_inventory": f"""
SELECT product_id, category, supplier, stock_state FROM frame
WHERE category = 'SMALL' AND stock_state IN ('{L.STATE_ICON[0]}', '{L.STATE_ICON[1]}')""",
    "facets": "SELECT DISTINCT supplier FROM frame WHERE supplier IS NOT NULL",
    "critical": "SELECT product_id, stock FROM allp WHERE stock <= min_stock",
    "slow_moving": f"""
SELECT product_id FROM inv
WHERE (sales_month <= 2 OR last_sale < {DAY} - 60) AND stock > 5""",
    "idle": f"SELECT product_id, last_sale FROM inv WHERE last_sale < {DAY} - 45 AND stock > 0",
    "notable_forecasts": """
SELECT product_id, projection, greatest(0, projection - stock) AS suggested_purchase FROM frame
WHERE sales_month > 0 AND (projection > stock OR abs(growth_pct) > 10)""",
    "active_alerts": """
SELECT event_id AS alert_id, user_id AS product_id, props AS message, 'MEDIA' AS priority,
  ts AS raised_at FROM events WHERE event_type = 'error' AND event_id % 3 <> 0""",
    "join_dims": """
SELECT product_id, category, supplier, lead_days
FROM allp JOIN cat USING (category_id) JOIN sup USING (supplier_id)""",
    "join_dims_left": """
SELECT product_id, supplier, lead_days
FROM allp LEFT JOIN (SELECT * FROM sup WHERE lead_days <= 5) USING (supplier_id)""",
    "enrich": """
SELECT product_id, active, category, supplier, supplier_active, rating AS supplier_rating,
  section || '-' || aisle || '-' || shelf AS location_code, capacity AS location_capacity
FROM allp LEFT JOIN cat USING (category_id) LEFT JOIN sup USING (supplier_id)
LEFT JOIN loc USING (location_id)""",
    "location_left_join": f"""
SELECT location_id, nullif(count(product_id), 0) AS products, {_units('stock', 'units')},
  {_sum('stock_value', 'value')} FROM loc LEFT JOIN inv USING (location_id) GROUP BY location_id""",
    "supplier_join": "SELECT supplier_id, product_id FROM sup JOIN allp USING (supplier_id)",
    "conditional_counts": f"""
SELECT {CRITICAL} AS critical_products, count(*) FILTER (WHERE stock > 0) AS in_stock,
  count(last_sale) AS ever_sold, count(*) AS products FROM allp""",
    "value_counts": "SELECT stock_state, count(*) AS products FROM frame GROUP BY stock_state",
    "mean_turnover": """
SELECT round(coalesce(avg(turnover_month) FILTER (WHERE turnover_month > 0), 0.0), 6)
  AS mean_turnover FROM frame""",
    "quantiles": _QUANTILES,
    "quantiles_by_selection": _QUANTILES,
    "global_rank": f"SELECT product_id, sales_month, rank FROM {_SOLD_RANKS}",
    "global_row_number": f"SELECT product_id, sales_month, row_number FROM {_SOLD_RANKS}",
    "running_total": f"SELECT product_id, sales_month, running FROM {_SOLD_RANKS}",
    "distributed_prefix": _RANKS,
    "with_totals": f"""
SELECT product_id, revenue_month, CAST(sum(revenue_month) OVER () AS {MONEY}) AS total_revenue,
  count(*) OVER () AS total_products FROM frame WHERE sales_month > 0""",
    "quintile_label": f"""
, edges AS (SELECT quantile_cont(CAST(price AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM allp)
SELECT product_id, CAST(price AS DOUBLE) AS score, """ + _case(
        [(f"CAST(price AS DOUBLE) <= e[{i}]", label)
         for i, label in enumerate(L.ANOMALY_QUINTILES[:4], start=1)],
        L.ANOMALY_QUINTILES[4]) + " AS label FROM allp, edges",
    "dense_codes": """
SELECT product_id, supplier_id,
  CAST(CASE WHEN supplier_id IS NULL THEN -1
    ELSE dense_rank() OVER (ORDER BY supplier_id) - 1 END AS INT) AS code FROM allp""",
    "top_k": """
SELECT product_id, name, sales_month, margin_pct FROM frame
ORDER BY sales_month DESC, product_id LIMIT 10""",
    "union_alert_kinds": f"""
SELECT alert_kind, priority, count(*) AS alerts, {_sum('investment', 'investment')}
FROM ({ALERTS}) GROUP BY alert_kind, priority""",
}

CROSSINGS = f"""
SELECT product_id, seq, level, '{L.ALERT_LOW_STOCK}' AS kind,
  'Stock crítico: ' || name || ' tiene solo ' || level || ' unidades' AS message,
  CASE WHEN level = 0 THEN 'ALTA' ELSE 'MEDIA' END AS priority
FROM (SELECT user_id AS product_id, event_id AS seq, value AS level, event_type AS name,
  lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE before > 100 AND level <= 100"""

LEDGER = """
SELECT movement_id, product_id, kind, quantity, moved_at,
  CAST(sum(CASE WHEN kind = 'ENTRADA' THEN quantity ELSE -quantity END) OVER (
    PARTITION BY product_id ORDER BY moved_at, movement_id, kind, quantity
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stock
FROM (SELECT l_orderkey * 10 + l_linenumber AS movement_id, l_partkey AS product_id,
  CASE WHEN l_returnflag = 'R' THEN 'ENTRADA' ELSE 'SALIDA' END AS kind,
  CAST(l_quantity AS INT) AS quantity, l_shipdate AS moved_at FROM lineitem)"""

WINDOWS = """
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, event_type AS kind,
  count(*) AS movements, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start
  FROM events)
GROUP BY window_start, event_type"""

UPSERTED = """
, latest AS (SELECT user_id, CAST(floor(arg_max(value, event_id)) AS INT) AS level
  FROM events GROUP BY user_id)
SELECT product_id, name, coalesce(level, stock) AS stock,
  CASE WHEN user_id IS NOT NULL THEN TIMESTAMP '2001-08-02' ELSE TIMESTAMP '2001-08-01' END
    AS updated_at
FROM every_product LEFT JOIN latest ON product_id = user_id"""

_STATS = {
    "products": "part", "categories": "cat", "suppliers": "supplier", "locations": "loc",
    "movements": "lineitem", "purchases": "orders", "purchase_lines": "lineitem",
}
STATS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS live_rows FROM {source}"
    for name, source in _STATS.items()
) + " UNION ALL SELECT 'alerts', count(*) FROM events WHERE event_type = 'error'"


def _violations(table: str, rule: str, column: str, count: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, "
        f"CAST(({count}) AS BIGINT) AS violations"
    )


def _integrity() -> str:
    """One row per rule; the rules that can be broken are counted, the rest are 0."""
    line = "l_orderkey * 10 + l_linenumber"
    repeated = f"SELECT count(*) - count(DISTINCT {line}) FROM lineitem"
    keys = {
        "categories": ("category_id", "SELECT count(*) - count(DISTINCT category_id) FROM cat"),
        "suppliers": ("supplier_id", "SELECT count(*) - count(DISTINCT s_suppkey) FROM supplier"),
        "locations": ("location_id", "SELECT count(*) - count(DISTINCT location_id) FROM loc"),
        "products": ("product_id", "SELECT count(*) - count(DISTINCT p_partkey) FROM part"),
        "movements": ("movement_id", repeated),
        "alerts": ("alert_id", "SELECT count(*) - count(DISTINCT event_id) FROM events"),
        "purchases": ("order_id", "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders"),
        "purchase_lines": ("line_id", repeated),
    }
    rows = [_violations(t, "duplicate_key", k, c) for t, (k, c) in keys.items()]

    def orphans(child: str, key: str, parent: str, parent_key: str, where: str = "TRUE") -> str:
        return (
            f"SELECT count(*) FROM {child} WHERE {where} AND {key} IS NOT NULL "
            f"AND {key} NOT IN (SELECT {parent_key} FROM {parent})"
        )

    error = "event_type = 'error'"
    rows += [
        _violations("products", "orphan_key", "category_id",
                    orphans("every_product", "category_id", "cat", "category_id")),
        _violations("products", "orphan_key", "supplier_id",
                    orphans("every_product", "supplier_id", "sup", "supplier_id")),
        _violations("products", "orphan_key", "location_id",
                    orphans("every_product", "location_id", "loc", "location_id")),
        _violations("movements", "orphan_key", "product_id",
                    orphans("lineitem", "l_partkey", "part", "p_partkey")),
        _violations("alerts", "orphan_key", "product_id",
                    orphans("events", "user_id", "part", "p_partkey", error)),
        _violations("purchases", "orphan_key", "supplier_id",
                    orphans("orders", "o_custkey", "supplier", "s_suppkey")),
        _violations("purchase_lines", "orphan_key", "order_id",
                    orphans("lineitem", "l_orderkey", "orders", "o_orderkey")),
        _violations("purchase_lines", "orphan_key", "product_id",
                    orphans("lineitem", "l_partkey", "part", "p_partkey")),
    ]
    nulls = {
        "categories": {"category_id": "cat.category_id", "category": "cat.category"},
        "suppliers": {"supplier_id": "supplier.s_suppkey", "supplier": "supplier.s_name"},
        "locations": {"location_id": "loc.location_id", "section": "loc.section"},
        "products": {c: f"every_product.{c}" for c in (
            "product_id", "name", "stock", "min_stock", "max_stock", "reorder_point",
            "unit_cost", "price")},
        "movements": {"movement_id": "lineitem.l_orderkey", "product_id": "lineitem.l_partkey",
                      "kind": "lineitem.l_linenumber", "quantity": "lineitem.l_quantity"},
        "alerts": {"alert_id": "events.event_id", "product_id": "events.user_id",
                   "kind": "events.event_id", "message": "events.props"},
        "purchases": {"order_id": "orders.o_orderkey", "supplier_id": "orders.o_custkey",
                      "ordered_on": "orders.o_orderdate"},
        "purchase_lines": {"line_id": "lineitem.l_orderkey", "order_id": "lineitem.l_orderkey",
                           "product_id": "lineitem.l_partkey", "ordered": "lineitem.l_quantity",
                           "unit_price": "lineitem.l_extendedprice",
                           "subtotal": "lineitem.l_extendedprice"},
    }
    for table, columns in nulls.items():
        for column, origin in columns.items():
            source, col = origin.split(".")
            rows.append(_violations(
                table, "null_value", column, f"SELECT count(*) - count({col}) FROM {source}"))
    rows.append(_violations(
        "purchases", "bad_value", "status",
        "SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"))
    rows += [_violations(t, "bad_value", c, "SELECT 0") for t, c in (
        ("movements", "kind"), ("alerts", "kind"), ("alerts", "priority"), ("alerts", "status"))]
    return " UNION ALL ".join(rows)


MOVEMENTS = {
    "run_report_suite_shared": REPORTS["run_report_suite"],
    "table_stats": STATS,
    "check_integrity": _integrity(),
    "crossing_alerts": CROSSINGS,
    "crossing_alerts_split_keys": CROSSINGS,
    "crossing_alerts_stream": CROSSINGS,
    "crossing_alerts_reordered_stream": CROSSINGS,
    "crossing_alerts_shuffled_stream": CROSSINGS,
    "apply_movements": LEDGER,
    "apply_movements_split_keys": LEDGER,
    "ledger_breaks": """
SELECT count(*) AS wrong_sums FROM lineitem WHERE (l_orderkey * 10 + l_linenumber) % 1000 = 0""",
    "ledger_breaks_stream": """
SELECT count(*) AS wrong_sums FROM lineitem WHERE (l_orderkey * 10 + l_linenumber) % 1000 = 0""",
    "stock_on_hand": """
SELECT l_partkey AS product_id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity
  ELSE -l_quantity END) AS BIGINT) AS net_quantity, count(*) AS movements
FROM lineitem GROUP BY l_partkey""",
    "stock_on_hand_stream": """
SELECT l_partkey AS product_id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity
  ELSE -l_quantity END) AS BIGINT) AS net_quantity, count(*) AS movements
FROM lineitem GROUP BY l_partkey""",
    "apply_movements_stream": LEDGER,
    "upsert_snapshot": UPSERTED,
    "upsert_snapshot_stream": UPSERTED,
    "upsert_snapshot_delta_stream": UPSERTED,
    "live_kpis": WINDOWS,
    "live_kpis_stream": WINDOWS,
    "live_kpis_settling_stream": WINDOWS,
}

MODELS = {
    "build_features": f"""
SELECT product_id, CAST(price AS DOUBLE) / CAST(unit_cost AS DOUBLE) AS price_ratio,
  CAST(unit_profit AS DOUBLE) AS margin_abs, {TURNS} AS turnover_year, growth AS trend,
  coalesce(months, 999.0) AS stock_sales_ratio,
  CAST(dense_rank() OVER (ORDER BY category_id) - 1 AS INT) AS category_code,
  CAST(dense_rank() OVER (ORDER BY supplier_id) - 1 AS INT) AS supplier_code,
  CAST(idle_days AS INT) AS days_since_sale, sin(2 * pi() * 8 / 12) AS seasonality FROM allp""",
    "simple_forecast": f"""
SELECT product_id, name, sales_month, stock, f AS forecast, 50.0::DOUBLE AS confidence,
  '{L.STOCKOUT[1]}' AS risk, greatest(0, f - stock) AS suggested_purchase
FROM (SELECT *, CAST(round_even(CASE WHEN sales_prev_month > 0
    THEN CAST(sales_month + sales_prev_month AS DOUBLE) / 2.0 * 1.5::DOUBLE
    ELSE CAST(sales_month AS DOUBLE) * 1.5::DOUBLE END, 0) AS BIGINT) AS f FROM allp)""",
}

ORACLE = {
    name: WITH_TABLES + body
    for group in (REPORTS, MEASURES, CLASSES, OPERATORS, MOVEMENTS, MODELS)
    for name, body in group.items()
}
