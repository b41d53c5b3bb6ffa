"""Trend and price-association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.demand import TABLE, enriched
from stockloom.catalog.registry import query
from stockloom.catalog.views import ENRICHED, PRODUCTS, SALES
from stockloom.operators import demand as d
from stockloom.operators import trends as tr

_NOW, _BEFORE = ("2000-07-01", "2000-12-31"), ("2000-01-01", "2000-06-30")


@query(
    "trd01_weekly_growth",
    f"""WITH {SALES}, {TABLE}, {PRODUCTS}, v AS (SELECT COALESCE(l0_category, 'UNMATCHED') AS category, CAST(date_trunc('week', date_) AS DATE) AS week,
      SUM(total_quantity) AS volume FROM demand d LEFT JOIN products p ON d.product_id = p.product_id GROUP BY 1, 2),
    w AS (SELECT * FROM v UNION ALL SELECT 'ALL', week, SUM(volume) FROM v GROUP BY week),
    x AS (SELECT w.category, w.week, w.volume, COALESCE(b.volume, 0.0) AS previous_volume FROM w LEFT JOIN w b
      ON w.category = b.category AND b.week = w.week - 7)
    SELECT *, CASE WHEN previous_volume > 0 THEN round_even((volume - previous_volume) / previous_volume * 100, 2) ELSE 0.0 END AS wow_growth_volume_pct FROM x""",
)
def _(t):
    return tr.weekly_growth(d.demand_table(t.sales), t.products)


def _movers_sql(key: str, source: str) -> str:
    n, b = ("date_ BETWEEN DATE '2000-07-01' AND DATE '2000-12-31'", "date_ BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'")
    return f"""g AS (SELECT {key} AS k, SUM(total_sales_value) FILTER ({n}) AS cr0, SUM(total_sales_value) FILTER ({b}) AS pr0, SUM(total_quantity) FILTER ({n}) AS cv0,
      SUM(total_quantity) FILTER ({b}) AS pv0 FROM {source} WHERE date_ BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1),
    z AS (SELECT k, COALESCE(cr0, 0.0) AS cr, COALESCE(pr0, 0.0) AS pr, COALESCE(cv0, 0.0) AS cv, COALESCE(pv0, 0.0) AS pv FROM g),
    m AS (SELECT k, ROUND(cr, 2) AS current_revenue, ROUND(pr, 2) AS previous_revenue, cv AS current_volume, pv AS previous_volume,
      CASE WHEN pr > 0 THEN round_even((cr - pr) / pr * 100, 1) ELSE 0.0 END AS revenue_change_pct,
      CASE WHEN pv > 0 THEN round_even((cv - pv) / pv * 100, 1) ELSE 0.0 END AS volume_change_pct, ROUND(cr - pr, 2) AS revenue_delta FROM z)"""


def _movers_out(key: str, n: int) -> str:
    cols = f"k AS {key}, * EXCLUDE (k)"
    return f"""SELECT {cols}, 'up' AS direction FROM (SELECT * FROM m ORDER BY revenue_delta DESC, k LIMIT {n})
    UNION ALL SELECT {cols}, 'down' AS direction FROM (SELECT * FROM m ORDER BY revenue_delta, k LIMIT {n})"""


def _round(df):
    return df.withColumns({c: F.round(c, 2) for c in ["current_revenue", "previous_revenue"]})


@query("trd02_product_movers", f"WITH {SALES}, {TABLE}, {_movers_sql('product_id', 'demand')} {_movers_out('product_id', 10)}")
def _(t):
    return _round(tr.movers(d.demand_table(t.sales), "product_id", _NOW, _BEFORE, 10))


@query(
    "trd02_brand_movers",
    f"""WITH {SALES}, {TABLE}, {PRODUCTS}, b AS (SELECT d.*, COALESCE(brand_name, 'UNMATCHED') AS brand FROM demand d LEFT JOIN products p
    ON d.product_id = p.product_id), {_movers_sql('brand', 'b')} {_movers_out('brand_name', 5)}""",
)
def _(t):
    return _round(tr.movers(d.demand_table(t.sales), "brand_name", _NOW, _BEFORE, 5, t.products))


@query(
    "trd03_discount_correlation",
    f"""WITH {ENRICHED}, r AS (SELECT COALESCE(l0_category, 'UNMATCHED') AS category, procured_quantity AS q,
      CASE WHEN procured_quantity * unit_selling_price > 0 THEN total_discount_amount / (procured_quantity * unit_selling_price) END AS dr FROM enriched)
    SELECT category, ROUND(CORR(dr, q), 6) AS discount_correlation, COUNT(dr) AS observations FROM r GROUP BY 1
    UNION ALL SELECT 'ALL', ROUND(CORR(dr, q), 6), COUNT(dr) FROM r""",
)
def _(t):
    return tr.discount_correlation(enriched(t))


@query(
    "trd04_discount_bands",
    f"""WITH {SALES}, r AS (SELECT *, ROUND(total_discount_amount / (procured_quantity * unit_selling_price), 6) AS dr FROM sales)
    SELECT CASE WHEN dr <= 0 THEN '<= 0' WHEN dr <= 0.03 THEN '0 - 0.03' WHEN dr <= 0.06 THEN '0.03 - 0.06' ELSE '> 0.06' END AS discount_band,
    COUNT(*) AS row_count, SUM(procured_quantity) AS total_quantity, ROUND(AVG(procured_quantity), 6) AS avg_quantity,
    ROUND(SUM(procured_quantity * unit_selling_price), 2) AS total_revenue FROM r GROUP BY 1""",
)
def _(t):
    return tr.discount_bands(t.sales, [0, 0.03, 0.06])


@query(
    "trd05_elasticity",
    f"""WITH {SALES}, {TABLE} SELECT product_id, COUNT(*) AS days, ROUND(REGR_SLOPE(LN(total_quantity), LN(avg_unit_price)), 6) AS elasticity,
    ROUND(REGR_R2(LN(total_quantity), LN(avg_unit_price)), 6) AS r_squared FROM demand
    WHERE total_quantity > 0 AND avg_unit_price > 0 GROUP BY 1 HAVING COUNT(*) >= 3""",
)
def _(t):
    return tr.elasticity(d.demand_table(t.sales), ["product_id"])


@query(
    "trd06_fast_selling",
    f"""WITH {SALES}, {TABLE}, c AS (SELECT product_id, COALESCE(SUM(total_quantity) FILTER (date_ BETWEEN DATE '2000-07-01' AND DATE '2000-12-31'), 0.0) AS cv,
      COALESCE(SUM(total_quantity) FILTER (date_ BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'), 0.0) AS pv FROM demand GROUP BY 1)
    SELECT product_id, cv AS current_volume, pv AS previous_volume, ROUND(cv / 184, 6) AS daily_now, ROUND(pv / 182, 6) AS daily_before
    FROM c WHERE pv > 0 AND cv / 184 >= pv / 182 * 1.5""",
)
def _(t):
    return tr.fast_selling(d.demand_table(t.sales), _NOW, _BEFORE)
