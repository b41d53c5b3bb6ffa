"""Inventory decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.cleaning import _LOOKUP, varied_costs
from stockloom.catalog.registry import query
from stockloom.catalog.views import FIRST_DAY, LAST_DAY, PANEL, PRODUCTS, SALES, SPAN, grid
from stockloom.operators import cleaning
from stockloom.operators import demand as d
from stockloom.operators import inventory as inv
from stockloom.operators import trends
from stockloom.schemas import SERIES_KEY

DEMAND = "demand AS (SELECT date_, product_id, city_name, SUM(procured_quantity) AS daily_quantity FROM sales GROUP BY 1, 2, 3)"
PARAMS = SPAN + f""",
params AS (SELECT product_id, city_name, ROUND(AVG(daily_quantity), 2) AS mean_daily_demand, ROUND(COALESCE(STDDEV_SAMP(daily_quantity), 0.0), 2) AS std_daily_demand,
  COUNT(*) AS active_days_in_window FROM demand WHERE date_ BETWEEN {LAST_DAY} - 29 AND {LAST_DAY} GROUP BY 1, 2)"""


def levels(source: str, lead: int = 3, z: float = 1.645, review: int = 7, name: str = "policy") -> str:
    return f"""{name}_ss AS (SELECT *, CAST(CEIL(ROUND({z} * std_daily_demand * SQRT({lead}), 9)) AS BIGINT) AS safety_stock, ROUND(mean_daily_demand * {lead}, 9) AS lead_time_demand FROM {source}),
{name} AS (SELECT *, CAST(CEIL(ROUND(lead_time_demand + safety_stock, 9)) AS BIGINT) AS reorder_point,
  CAST(CEIL(ROUND(mean_daily_demand * {lead + review} + safety_stock, 9)) AS BIGINT) AS target_stock_level FROM {name}_ss)"""


def _demand(t):
    grouped = t.sales.groupBy("date_", *SERIES_KEY)
    return grouped.agg(F.sum("procured_quantity").alias("daily_quantity"))


def params(t):
    return inv.demand_params(_demand(t), t.days.cut, t.days.last)


def policy(t):
    return inv.inventory_policy(params(t))


BASE = f"{SALES}, {DEMAND}, {PARAMS}, {levels('params')}"
_COLS = "product_id, city_name, mean_daily_demand, std_daily_demand, safety_stock, reorder_point, target_stock_level"
_NAMES = _COLS.split(", ")


@query("inv01_demand_params", f"WITH {SALES}, {DEMAND}, {PARAMS} SELECT * FROM params")
def _(t):
    return params(t)


@query(
    "inv02_policy_costs",
    f"""WITH {_LOOKUP}, {DEMAND}, {PARAMS} SELECT p.product_id, p.city_name, recovered_landing_price AS unit_cost, COALESCE(recovery_tier, 'ORIGINAL_VALID_IN_MASTER') AS cost_data_status
    FROM params p LEFT JOIN lookup l ON p.product_id = l.product_id AND p.city_name = l.city_name""",
)
def _(t):
    lookup = cleaning.cost_recovery_lookup(varied_costs(t))
    return inv.inventory_policy(params(t), lookup).select(*SERIES_KEY, "unit_cost", "cost_data_status")


@query(
    "inv03_policy",
    f"""WITH {BASE} SELECT {_COLS}, active_days_in_window, CAST(NULL AS DOUBLE) AS unit_cost, 'ORIGINAL_VALID_IN_MASTER' AS cost_data_status, CAST(3 AS INTEGER) AS lead_time_days_param,
    CAST(0.95 AS DOUBLE) AS target_service_level_param, lead_time_demand, 'NOT_AVAILABLE_IN_SOURCE (Configured Parameter)' AS lead_time_source,
    'NOT_AVAILABLE_IN_SOURCE (Configured Parameter)' AS service_level_source FROM policy""",
)
def _(t):
    return policy(t)


@query(
    "inv04_recompute",
    f"WITH {SALES}, {DEMAND}, {PARAMS}, {levels('params', 5, 2.326)} SELECT {_COLS} FROM policy WHERE lower(city_name) = 'asia'"
    " ORDER BY mean_daily_demand DESC, product_id, city_name LIMIT 100",
)
def _(t):
    return inv.recompute(policy(t), 5, 0.99, city="Asia", limit=100).select(*_NAMES)


MOVES = PANEL + ",\n" + grid("panel", FIRST_DAY, LAST_DAY) + f""",
moves AS (SELECT product_id, city_name, date_ AS snapshot_date, CASE WHEN dayofmonth(date_) % 10 = 0 THEN 40.0 ELSE 0.0 END AS stock_received,
  daily_quantity AS sales_quantity, CAST(date_ - {FIRST_DAY} AS BIGINT) AS i FROM grid),
ledger(product_id, city_name, i, snapshot_date, opening_stock, stock_received, sales_quantity, closing_stock) AS (
  SELECT product_id, city_name, i, snapshot_date, CAST(100.0 AS DOUBLE), CAST(stock_received AS DOUBLE), sales_quantity, greatest(CAST(0.0 AS DOUBLE), 100.0 + stock_received - sales_quantity) FROM moves WHERE i = 0
  UNION ALL
  SELECT m.product_id, m.city_name, m.i, m.snapshot_date, l.closing_stock, CAST(m.stock_received AS DOUBLE), m.sales_quantity, greatest(CAST(0.0 AS DOUBLE), l.closing_stock + m.stock_received - m.sales_quantity)
  FROM ledger l JOIN moves m ON m.product_id = l.product_id AND m.city_name = l.city_name AND m.i = l.i + 1)"""
_LEDGER = "product_id, city_name, snapshot_date, opening_stock, stock_received, sales_quantity, closing_stock"


def ledger(t):
    return inv.roll_forward(t.movements, 100.0)


@query("inv05_roll_forward", f"WITH RECURSIVE {MOVES} SELECT {_LEDGER} FROM ledger")
def _(t):
    return ledger(t)


_RECS = "recs AS (SELECT product_id, city_name, ROUND(AVG(daily_quantity), 2) AS avg_daily_demand FROM panel GROUP BY 1, 2)"
COVER = f"""{MOVES}, {_RECS}, cover AS (SELECT l.*, round_even(closing_stock / greatest(1.0, COALESCE(avg_daily_demand, greatest(1.0, sales_quantity))), 1) AS days_of_cover
  FROM ledger l LEFT JOIN recs r ON l.product_id = r.product_id AND l.city_name = r.city_name)"""
_RISK = """CASE WHEN days_of_cover <= 2 THEN 'CRITICAL_STOCKOUT' WHEN days_of_cover <= 4 THEN 'REORDER_RECOMMENDED' WHEN days_of_cover > 15 THEN 'OVERSTOCK' ELSE 'OPTIMAL' END AS stockout_risk,
  CASE WHEN days_of_cover <= 2 THEN 'HIGH' WHEN days_of_cover <= 4 THEN 'MEDIUM' WHEN days_of_cover > 15 THEN 'LOW' ELSE 'NONE' END AS reorder_urgency,
  CASE WHEN days_of_cover <= 2 THEN 'Trigger Emergency Replenishment' WHEN days_of_cover <= 4 THEN 'Issue Supplier Reorder' WHEN days_of_cover > 15 THEN 'Surplus Inventory - Pause PO'
    ELSE 'Stock Buffer Adequate' END AS action_text"""


def _recs(t):
    rows = t.panel.groupBy(*SERIES_KEY)
    return rows.agg(F.round(F.avg("daily_quantity"), 2).alias("avg_daily_demand"))


@query("inv06_days_of_cover", f"WITH RECURSIVE {COVER} SELECT {_LEDGER}, days_of_cover FROM cover")
def _(t):
    return inv.days_of_cover(ledger(t), _recs(t))


@query("inv07_cover_risk", f"WITH RECURSIVE {COVER} SELECT product_id, city_name, snapshot_date, {_RISK} FROM cover")
def _(t):
    rows = inv.cover_risk(inv.days_of_cover(ledger(t), _recs(t)))
    return rows.select(*SERIES_KEY, "snapshot_date", "stockout_risk", "reorder_urgency", "action_text")


# Stock on hand derived from the ids: from empty to far above target.
_STOCK = """stock AS (SELECT product_id, city_name, CAST((product_id * 37 + length(city_name) * 11) % 400 AS DOUBLE) AS current_stock FROM params)"""
RECS = f"""{BASE}, {_STOCK}, recs AS (SELECT p.product_id, p.city_name, current_stock, mean_daily_demand AS avg_daily_demand, CAST(3 AS INTEGER) AS lead_time_days, safety_stock, reorder_point, target_stock_level,
  CAST(NULL AS DOUBLE) AS unit_cost, CASE WHEN current_stock <= reorder_point THEN round_even(target_stock_level - current_stock, 1) ELSE 0.0 END AS recommended_order_qty,
  CASE WHEN current_stock < safety_stock THEN 'CRITICAL_STOCKOUT' WHEN current_stock <= reorder_point THEN 'REORDER_RECOMMENDED' WHEN current_stock > target_stock_level * CAST(1.4 AS DOUBLE) THEN 'OVERSTOCK' ELSE 'OPTIMAL' END AS risk_status,
  CASE WHEN current_stock < safety_stock THEN 'HIGH' WHEN current_stock <= reorder_point THEN 'MEDIUM' ELSE 'LOW' END AS priority
  FROM policy p JOIN stock s ON p.product_id = s.product_id AND p.city_name = s.city_name)"""


def recommendations(t):
    current = ((F.col("product_id") * 37 + F.length("city_name") * 11) % 400).cast("double")
    rows = policy(t)
    return inv.recommend_orders(rows, rows.select(*SERIES_KEY, current.alias("current_stock")))


@query("inv08_recommend_orders", f"WITH {RECS} SELECT * FROM recs")
def _(t):
    return recommendations(t)


@query(
    "inv09_status_listing",
    f"""WITH RECURSIVE {COVER}, {PRODUCTS} SELECT c.product_id, 'SKU #' || c.product_id AS product_name, city_name, snapshot_date, round_even(opening_stock, 1) AS opening_stock, round_even(stock_received, 1) AS stock_received,
    round_even(sales_quantity, 1) AS sales_quantity, round_even(closing_stock, 1) AS closing_stock, days_of_cover, {_RISK} FROM cover c
    WHERE lower(city_name) = 'europe' ORDER BY snapshot_date DESC, c.product_id, city_name LIMIT 60""",
)
def _(t):
    names = t.products.withColumn("product_id", F.col("product_id").cast("string"))
    return inv.inventory_status(ledger(t), _recs(t), names, city="Europe", limit=60)


@query(
    "inv10_list_recommendations",
    f"WITH {RECS} SELECT * FROM recs WHERE lower(city_name) = 'africa' ORDER BY avg_daily_demand DESC, product_id, city_name LIMIT 100",
)
def _(t):
    return inv.list_recommendations(recommendations(t), city="africa", limit=100)


_VOL = f"""{BASE}, vol AS (SELECT *, CASE WHEN mean_daily_demand > 0 THEN std_daily_demand / mean_daily_demand ELSE 0.0 END AS cv0 FROM policy),
st AS (SELECT *, CASE WHEN cv0 > 0.35 OR reorder_point > 20000 THEN 'HIGH_VOLATILITY' WHEN cv0 > 0.2 OR reorder_point > 10000 THEN 'ATTENTION_NEEDED' ELSE 'SAFE' END AS status FROM vol)"""


@query("inv11_volatility_status", f"WITH {_VOL} SELECT product_id, city_name, ROUND(cv0, 6) AS cv, status FROM st")
def _(t):
    return inv.volatility_status(policy(t)).select(*SERIES_KEY, "cv", "status")


@query(
    "inv11_volatility_counts",
    f"""WITH {_VOL} SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'HIGH_VOLATILITY') AS high_volatility, COUNT(*) FILTER (status = 'ATTENTION_NEEDED') AS attention_needed,
    COUNT(*) FILTER (status = 'SAFE') AS safe, CAST(ROUND(AVG(safety_stock)) AS BIGINT) AS avg_safety_stock FROM st""",
)
def _(t):
    return inv.volatility_counts(inv.volatility_status(policy(t)))


@query(
    "inv12_at_risk",
    f"""WITH {RECS} SELECT * FROM recs WHERE risk_status IN ('CRITICAL_STOCKOUT', 'REORDER_RECOMMENDED') AND city_name IN ('ASIA', 'AFRICA')
    ORDER BY recommended_order_qty DESC, product_id, city_name LIMIT 5""",
)
def _(t):
    return inv.at_risk(recommendations(t), None, ["ASIA", "AFRICA"], 5)


@query(
    "inv13_prefer_actual",
    f"""WITH RECURSIVE {MOVES} SELECT product_id, city_name, snapshot_date, CASE WHEN dayofmonth(snapshot_date) = 1 THEN closing_stock + 5 ELSE closing_stock END AS closing_stock,
    CASE WHEN dayofmonth(snapshot_date) = 1 THEN 'actual_inventory' ELSE 'model_derived_inventory' END AS stock_source FROM ledger""",
)
def _(t):
    keys = [*SERIES_KEY, "snapshot_date"]
    derived = ledger(t).select(*keys, "closing_stock")
    counted = derived.where(F.dayofmonth("snapshot_date") == 1).withColumn("closing_stock", F.col("closing_stock") + 5)
    return inv.prefer_actual(counted, derived, keys)


@query(
    "inv14_eoq",
    """WITH y AS (SELECT l_partkey AS product_id, SUM(l_quantity) AS annual_demand FROM lineitem GROUP BY 1), x AS (SELECT y.product_id, annual_demand,
      CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS ordering_cost, p_retailprice * 0.2 AS holding_cost FROM y JOIN part ON p_partkey = y.product_id)
    SELECT product_id, annual_demand, ordering_cost, ROUND(holding_cost, 4) AS holding_cost,
    ROUND(CASE WHEN annual_demand > 0 AND ordering_cost > 0 AND holding_cost > 0 THEN SQRT(2 * annual_demand * ordering_cost / holding_cost) END, 2) AS eoq FROM x""",
)
def _(t):
    year = t.read("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("annual_demand"))
    rows = year.join(t.read("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("product_id"),
        "annual_demand",
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("ordering_cost"),
        (F.col("p_retailprice") * 0.2).alias("holding_cost"),
    )
    return inv.eoq(rows).withColumn("holding_cost", F.round("holding_cost", 4))


@query(
    "inv15_top_policies",
    f"WITH {BASE} SELECT {_COLS} FROM policy WHERE city_name IN ('EUROPE') ORDER BY safety_stock DESC, mean_daily_demand DESC, product_id, city_name LIMIT 5",
)
def _(t):
    return inv.top_policies(policy(t), None, ["EUROPE"], 5).select(*_NAMES)


_CHANGE = f"""{RECS}, g AS (SELECT product_id, city_name, COALESCE(SUM(daily_quantity) FILTER (date_ >= DATE '2000-07-01' AND date_ <= DATE '2000-12-31'), 0.0) AS cv,
  COALESCE(SUM(daily_quantity) FILTER (date_ >= DATE '2000-01-01' AND date_ <= DATE '2000-06-30'), 0.0) AS pv FROM demand WHERE date_ BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1, 2),
x AS (SELECT r.product_id, r.city_name, risk_status, CASE WHEN pv > 0 THEN round_even((cv - pv) / pv * 100, 1) ELSE 0.0 END AS volume_change_pct
  FROM recs r JOIN g ON r.product_id = g.product_id AND r.city_name = g.city_name)"""


@query(
    "trd06_stock_mismatch",
    f"""WITH {_CHANGE}, m AS (SELECT *, CASE WHEN risk_status IN ('CRITICAL_STOCKOUT', 'REORDER_RECOMMENDED') AND volume_change_pct > 0 THEN 'RISING_DEMAND_LOW_STOCK'
      WHEN risk_status = 'OVERSTOCK' AND volume_change_pct < 0 THEN 'FALLING_DEMAND_OVERSTOCK' END AS mismatch FROM x)
    SELECT * FROM m WHERE mismatch IS NOT NULL""",
)
def _(t):
    growth = d.period_change(d.demand_table(t.sales), ("2000-07-01", "2000-12-31"), ("2000-01-01", "2000-06-30"), SERIES_KEY)
    rows = trends.mismatch(recommendations(t), growth)
    return rows.select(*SERIES_KEY, "risk_status", "volume_change_pct", "mismatch")
