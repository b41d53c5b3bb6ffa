"""Demand aggregation and business-figure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.cleaning import _COSTS, _IMPUTED, _VARIED, _imputed, costs_of
from stockloom.catalog.registry import query
from stockloom.catalog.views import ENRICHED, PRODUCTS, SALES
from stockloom.operators import cleaning
from stockloom.operators import demand as d

REV = "procured_quantity * unit_selling_price"
_NOW, _BEFORE = ("2000-07-01", "2000-12-31"), ("2000-01-01", "2000-06-30")


def enriched(t):
    return cleaning.enrich(t.sales, t.products)


@query(
    "agg01_daily_demand",
    f"""WITH {ENRICHED} SELECT date_, product_id, product_name, city_name, l0_category, l1_category, l2_category,
    SUM(procured_quantity) AS daily_quantity, ROUND(SUM({REV}), 2) AS daily_revenue, COUNT(DISTINCT order_id) AS order_count
    FROM enriched GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
def _(t):
    return d.named_daily_demand(t.sales, t.products).withColumn("daily_revenue", F.round("daily_revenue", 2))


@query(
    "agg02_daily_demand_simple",
    f"""WITH {_IMPUTED} SELECT date_, product_id, city_name, SUM(procured_quantity) AS daily_quantity,
    ROUND(AVG(unit_selling_price), 8) AS avg_selling_price, ROUND(AVG(recovered_landing_price), 8) AS recovered_landing_price
    FROM imputed WHERE city_name IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    demand = d.daily_demand_simple(_imputed(t))
    return demand.withColumns({c: F.round(c, 8) for c in ["avg_selling_price", "recovered_landing_price"]})


TABLE = """demand AS (SELECT date_, product_id, city_name, SUM(procured_quantity) AS total_quantity,
  SUM(procured_quantity * unit_selling_price) AS total_sales_value, SUM(total_discount_amount) AS total_discount_value,
  AVG(unit_selling_price) AS avg_unit_price, COUNT(DISTINCT order_id) AS order_count FROM sales GROUP BY 1, 2, 3)"""


@query(
    "agg03_demand_table",
    f"""WITH {SALES}, {TABLE} SELECT date_, product_id, city_name, total_quantity, ROUND(total_sales_value, 2) AS total_sales_value,
    ROUND(total_discount_value, 4) AS total_discount_value, ROUND(avg_unit_price, 8) AS avg_unit_price, order_count FROM demand""",
)
def _(t):
    digits = {"total_sales_value": 2, "total_discount_value": 4, "avg_unit_price": 8}
    return d.demand_table(t.sales).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "agg04_overview",
    f"""WITH {ENRICHED} SELECT COUNT(*) AS total_rows, COUNT(DISTINCT product_id) AS total_products, COUNT(DISTINCT city_name) AS total_cities,
    COUNT(DISTINCT date_) AS unique_dates, MIN(date_) AS min_date, MAX(date_) AS max_date, COUNT(DISTINCT l0_category) AS unique_l0,
    COUNT(DISTINCT l1_category) AS unique_l1, COUNT(DISTINCT l2_category) AS unique_l2, SUM(procured_quantity) AS total_quantity,
    ROUND(SUM({REV}), 2) AS total_revenue FROM enriched""",
)
def _(t):
    return d.overview(t.sales, t.products)


@query(
    "agg05_city_kpis",
    f"""WITH {SALES}, k AS (SELECT city_name, COUNT(*) AS transaction_rows, SUM(procured_quantity) AS total_quantity,
      ROUND(SUM({REV}), 2) AS total_revenue, COUNT(DISTINCT product_id) AS unique_products,
      ROUND(SUM(procured_quantity) / COUNT(DISTINCT date_), 1) AS avg_daily_quantity,
      ROUND(SUM({REV}) / COUNT(DISTINCT date_), 2) AS avg_daily_revenue FROM sales GROUP BY 1)
    SELECT *, ROUND(total_revenue / (SELECT SUM(total_revenue) FROM k) * 100, 2) AS revenue_share_pct,
    ROUND(total_quantity / (SELECT SUM(total_quantity) FROM k) * 100, 2) AS quantity_share_pct FROM k""",
)
def _(t):
    return d.city_kpis(t.sales)


@query(
    "agg06_category_kpis",
    f"""WITH {ENRICHED}, k AS (SELECT COALESCE(l0_category, 'UNMATCHED_PRODUCTS') AS l0_category, COUNT(*) AS transaction_rows,
      SUM(procured_quantity) AS total_quantity, ROUND(SUM({REV}), 2) AS total_revenue, COUNT(DISTINCT product_id) AS unique_products
      FROM enriched GROUP BY 1)
    SELECT *, ROUND(total_revenue / (SELECT SUM(total_revenue) FROM k) * 100, 2) AS revenue_share_pct,
    ROUND(total_quantity / (SELECT SUM(total_quantity) FROM k) * 100, 2) AS quantity_share_pct FROM k""",
)
def _(t):
    return d.category_kpis(t.sales, t.products)


def _top_sql(levels: list[str], n: int) -> str:
    names = ", ".join(f"COALESCE({c}, 'UNMATCHED') AS {c}" for c in levels)
    keys = ", ".join(str(i + 1) for i in range(len(levels)))
    order = ", ".join(levels)
    return f"""WITH {ENRICHED}, k AS (SELECT {names}, COUNT(*) AS transaction_rows, SUM(procured_quantity) AS total_quantity,
      ROUND(SUM({REV}), 2) AS total_revenue, COUNT(DISTINCT product_id) AS unique_products FROM enriched GROUP BY {keys})
    SELECT *, ROUND(total_revenue / (SELECT SUM(total_revenue) FROM k) * 100, 2) AS revenue_share_pct FROM k
    ORDER BY total_revenue DESC, {order} LIMIT {n}"""


@query("agg07_top_l0_l1", _top_sql(["l0_category", "l1_category"], 20))
def _(t):
    return d.category_top(t.sales, t.products, ["l0_category", "l1_category"], 20)


@query("agg07_top_l2", _top_sql(["l2_category"], 15))
def _(t):
    return d.category_top(t.sales, t.products, ["l2_category"], 15)


def _products_sql(order: str, n: int) -> str:
    return f"""WITH {ENRICHED} SELECT product_id, COALESCE(product_name, 'UNMATCHED_PRODUCT') AS product_name,
    COALESCE(l0_category, 'UNMATCHED') AS category, SUM(procured_quantity) AS total_quantity, ROUND(SUM({REV}), 2) AS total_revenue
    FROM enriched GROUP BY product_id, product_name, l0_category ORDER BY {order}, product_id LIMIT {n}"""


@query("agg08_top_products_by_quantity", _products_sql("total_quantity DESC", 20))
def _(t):
    return d.top_products(t.sales, t.products, "total_quantity", 20)


@query("agg08_top_products_by_revenue", _products_sql("total_revenue DESC", 20))
def _(t):
    return d.top_products(t.sales, t.products, "total_revenue", 20)


@query("agg09_low_products", _products_sql("total_revenue", 10))
def _(t):
    return d.low_products(t.sales, t.products, 10)


DAILY = f"""daily AS (SELECT date_, COUNT(*) AS transaction_rows, SUM(procured_quantity) AS daily_quantity, ROUND(SUM({REV}), 2) AS daily_revenue,
  CAST(isodow(date_) - 1 AS INTEGER) AS day_of_week, strftime(date_, '%A') AS day_name, strftime(date_, '%Y-%m') AS month_str,
  CASE WHEN isodow(date_) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM sales GROUP BY date_)"""


@query("agg10_daily_trend", f"WITH {SALES}, {DAILY} SELECT * FROM daily")
def _(t):
    return d.daily_trend(t.sales)


@query(
    "agg11_monthly_summary",
    f"""WITH {SALES}, {DAILY} SELECT month_str, COUNT(*) AS active_days, SUM(daily_quantity) AS total_quantity,
    ROUND(SUM(daily_revenue), 2) AS total_revenue, ROUND(AVG(daily_quantity), 1) AS avg_daily_quantity,
    ROUND(AVG(daily_revenue), 2) AS avg_daily_revenue FROM daily GROUP BY 1""",
)
def _(t):
    return d.monthly_summary(d.daily_trend(t.sales))


@query(
    "agg12_weekday_summary",
    f"""WITH {SALES}, {DAILY}, week AS (SELECT CAST(i AS INTEGER) AS day_order, n AS day_name FROM (VALUES (0, 'Monday'), (1, 'Tuesday'),
      (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) v(i, n)),
    s AS (SELECT day_name, COUNT(*) AS total_days, ROUND(AVG(daily_quantity), 4) AS avg_daily_quantity,
      ROUND(AVG(daily_revenue), 4) AS avg_daily_revenue, SUM(daily_quantity) AS total_quantity, ROUND(SUM(daily_revenue), 2) AS total_revenue
      FROM daily GROUP BY 1)
    SELECT w.day_name, day_order, total_days, avg_daily_quantity, avg_daily_revenue, total_quantity, total_revenue
    FROM week w LEFT JOIN s ON w.day_name = s.day_name""",
)
def _(t):
    return d.dow_summary(d.daily_trend(t.sales))


@query(
    "agg13_weekend_summary",
    f"""WITH {SALES}, {DAILY} SELECT day_type, COUNT(*) AS total_days, ROUND(AVG(daily_quantity), 1) AS avg_daily_quantity,
    ROUND(AVG(daily_revenue), 2) AS avg_daily_revenue, SUM(daily_quantity) AS total_quantity, ROUND(SUM(daily_revenue), 2) AS total_revenue
    FROM daily GROUP BY 1""",
)
def _(t):
    return d.weekend_summary(d.daily_trend(t.sales))


@query(
    "agg14_price_discount_stats",
    f"""WITH {SALES} SELECT ROUND(AVG(unit_selling_price), 2) AS mean_price, ROUND(MAX(unit_selling_price), 2) AS max_price,
    ROUND(SUM(total_discount_amount), 2) AS total_discount_given, COUNT(*) FILTER (total_discount_amount > 0) AS discounted_rows,
    COUNT(*) FILTER (total_discount_amount = 0) AS zero_discount_rows,
    ROUND(AVG(total_discount_amount) FILTER (total_discount_amount > 0), 2) AS mean_discount_when_present,
    ROUND(MAX(total_discount_amount), 2) AS max_discount, ROUND(MEDIAN(unit_selling_price), 2) AS median_price,
    ROUND(QUANTILE_CONT(unit_selling_price, 0.25), 2) AS p25_price, ROUND(QUANTILE_CONT(unit_selling_price, 0.75), 2) AS p75_price,
    ROUND(QUANTILE_CONT(unit_selling_price, 0.9), 2) AS p90_price, ROUND(QUANTILE_CONT(unit_selling_price, 0.99), 2) AS p99_price,
    ROUND(MEDIAN(total_discount_amount) FILTER (total_discount_amount > 0), 2) AS median_discount_when_present FROM sales""",
)
def _(t):
    return d.price_discount_stats(t.sales)


@query(
    "agg15_extreme_days",
    f"""WITH {SALES}, {DAILY} SELECT (SELECT date_ FROM daily ORDER BY daily_revenue DESC, date_ LIMIT 1) AS best_day,
    (SELECT MAX(daily_revenue) FROM daily) AS best_revenue, (SELECT date_ FROM daily ORDER BY daily_revenue, date_ LIMIT 1) AS worst_day,
    (SELECT MIN(daily_revenue) FROM daily) AS worst_revenue""",
)
def _(t):
    return d.extreme_days(d.daily_trend(t.sales))


_PARETO = f"""totals AS (SELECT product_id, ROUND(SUM({REV}), 4) AS revenue, SUM(procured_quantity) AS quantity FROM sales GROUP BY 1),
pareto AS (SELECT t.product_id, t.revenue, t.quantity, SUM(o.revenue) FILTER (o.revenue >= t.revenue) / SUM(o.revenue) AS cum_revenue_share,
  SUM(o.quantity) FILTER (o.quantity >= t.quantity) / SUM(o.quantity) AS cum_quantity_share,
  COUNT(*) FILTER (o.revenue > t.revenue OR (o.revenue = t.revenue AND o.product_id <= t.product_id)) AS product_rank, COUNT(*) AS product_count
  FROM totals t CROSS JOIN totals o GROUP BY 1, 2, 3)"""


@query(
    "agg16_pareto",
    f"""WITH {SALES}, {_PARETO} SELECT product_id, ROUND(revenue, 2) AS revenue, quantity, ROUND(cum_revenue_share, 8) AS cum_revenue_share,
    ROUND(cum_quantity_share, 8) AS cum_quantity_share, product_rank, product_count FROM pareto""",
)
def _(t):
    digits = {"revenue": 2, "cum_revenue_share": 8, "cum_quantity_share": 8}
    return d.pareto(t.sales).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "agg17_concentration",
    f"""WITH {SALES}, {_PARETO}, n AS (SELECT MAX(product_count) AS c, MIN(product_rank) FILTER (cum_revenue_share >= 0.8) AS k FROM pareto)
    SELECT c AS products, ROUND((SELECT cum_revenue_share FROM pareto WHERE product_rank = CEIL(ROUND(c * 0.1, 6))) * 100, 4) AS top_10pct_share,
    ROUND((SELECT cum_revenue_share FROM pareto WHERE product_rank = CEIL(ROUND(c * 0.2, 6))) * 100, 4) AS top_20pct_share,
    k AS products_for_target, ROUND(k / c * 100, 4) AS target_pct_of_catalog FROM n""",
)
def _(t):
    return d.concentration(d.pareto(t.sales))


_ABC = f"""totals AS (SELECT product_id, ROUND(SUM({REV}), 2) AS revenue, SUM(procured_quantity) AS quantity FROM sales GROUP BY 1),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY revenue DESC, product_id) AS row_rank, revenue / (SELECT SUM(revenue) FROM totals) * 100 AS share_pct,
  SUM(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING) / (SELECT SUM(revenue) FROM totals) * 100 AS cumulative_pct FROM totals),
abc AS (SELECT *, CASE WHEN ROUND(cumulative_pct, 9) <= 80 THEN 'A' WHEN ROUND(cumulative_pct, 9) <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM ranked)"""


def _abc(t):
    totals = t.sales.groupBy("product_id").agg(
        F.round(F.sum(d.revenue()), 2).alias("revenue"), F.sum(d.quantity()).alias("quantity")
    )
    return d.abc_classify(totals, "revenue")


@query(
    "agg18_abc_classes",
    f"""WITH {SALES}, {_ABC} SELECT product_id, revenue, quantity, row_rank, ROUND(share_pct, 8) AS share_pct,
    ROUND(cumulative_pct, 6) AS cumulative_pct, abc_class FROM abc""",
)
def _(t):
    return _abc(t).withColumns({"share_pct": F.round("share_pct", 8), "cumulative_pct": F.round("cumulative_pct", 6)})


@query(
    "agg19_abc_summary",
    f"""WITH {SALES}, {_ABC} SELECT abc_class, COUNT(*) AS products, SUM(quantity) AS quantity, ROUND(SUM(revenue), 2) AS revenue,
    ROUND(SUM(revenue) / (SELECT SUM(revenue) FROM abc) * 100, 2) AS revenue_share_pct,
    ROUND(COUNT(*) / (SELECT COUNT(*) FROM abc) * 100, 2) AS product_share_pct FROM abc GROUP BY 1""",
)
def _(t):
    return d.abc_summary(_abc(t))


def _change_cols() -> str:
    n = "date_ BETWEEN DATE '2000-07-01' AND DATE '2000-12-31'"
    b = "date_ BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'"
    return f"""COALESCE(SUM(total_sales_value) FILTER ({n}), 0.0) AS cr, COALESCE(SUM(total_sales_value) FILTER ({b}), 0.0) AS pr,
      COALESCE(SUM(total_quantity) FILTER ({n}), 0.0) AS cv, COALESCE(SUM(total_quantity) FILTER ({b}), 0.0) AS pv"""


CHANGE = """SELECT {key} ROUND(cr, 2) AS current_revenue, ROUND(pr, 2) AS previous_revenue, cv AS current_volume, pv AS previous_volume,
  CASE WHEN pr > 0 THEN round_even((cr - pr) / pr * 100, 1) ELSE 0.0 END AS revenue_change_pct,
  CASE WHEN pv > 0 THEN round_even((cv - pv) / pv * 100, 1) ELSE 0.0 END AS volume_change_pct FROM c"""
_YEAR = "date_ BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"


def rounded_change(df):
    return df.withColumns({c: F.round(c, 2) for c in ["current_revenue", "previous_revenue"]})


@query(
    "agg28_period_change",
    f"WITH {SALES}, {TABLE}, c AS (SELECT {_change_cols()} FROM demand WHERE {_YEAR}) {CHANGE.format(key='')}",
)
def _(t):
    return rounded_change(d.period_change(d.demand_table(t.sales), _NOW, _BEFORE))


@query(
    "agg28_period_change_by_city",
    f"WITH {SALES}, {TABLE}, c AS (SELECT city_name, {_change_cols()} FROM demand WHERE {_YEAR} GROUP BY 1)"
    f" {CHANGE.format(key='city_name,')}",
)
def _(t):
    return rounded_change(d.period_change(d.demand_table(t.sales), _NOW, _BEFORE, ["city_name"]))


@query(
    "agg29_business_health",
    f"""WITH {SALES}, {TABLE}, c AS (SELECT {_change_cols()} FROM demand WHERE {_YEAR}), x AS ({CHANGE.format(key='')}),
    n AS (SELECT * FROM demand WHERE date_ BETWEEN DATE '2000-07-01' AND DATE '2000-12-31')
    SELECT 'growth' AS section, 'current_revenue' AS label, current_revenue AS value FROM x
    UNION ALL SELECT 'growth', 'previous_revenue', previous_revenue FROM x
    UNION ALL SELECT 'growth', 'revenue_change_pct', ROUND(revenue_change_pct, 2) FROM x
    UNION ALL SELECT 'growth', 'volume_change_pct', ROUND(volume_change_pct, 2) FROM x
    UNION ALL SELECT 'city', city_name, ROUND(SUM(total_sales_value), 2) FROM n GROUP BY city_name
    UNION ALL SELECT * FROM (SELECT 'top_product', CAST(product_id AS VARCHAR) AS label, ROUND(SUM(total_sales_value), 2) AS value
      FROM n GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)""",
)
def _(t):
    return d.business_health(d.demand_table(t.sales), _NOW, _BEFORE)


@query(
    "agg30_product_performance",
    f"""WITH {SALES}, {TABLE} SELECT product_id, ROUND(SUM(total_sales_value), 2) AS total_revenue, ROUND(SUM(total_quantity), 1) AS total_quantity,
    ROUND(AVG(avg_unit_price), 2) AS avg_selling_price FROM demand WHERE city_name IN ('ASIA', 'EUROPE') GROUP BY 1
    ORDER BY total_revenue DESC, product_id LIMIT 5""",
)
def _(t):
    return d.product_performance(d.demand_table(t.sales), None, ["ASIA", "EUROPE"], 5)


@query(
    "agg31_city_performance",
    f"""WITH {SALES}, {TABLE} SELECT city_name, ROUND(SUM(total_sales_value), 2) AS total_revenue, ROUND(SUM(total_quantity), 1) AS total_quantity,
    COUNT(DISTINCT product_id) AS active_skus FROM demand GROUP BY 1""",
)
def _(t):
    return d.city_performance(d.demand_table(t.sales))


@query(
    "agg32_profit",
    f"""WITH {_VARIED}, {TABLE}, {_COSTS}, g AS (SELECT product_id, ROUND(MIN_BY(unit_cost, city_name), 2) AS unit_cost FROM costs WHERE unit_cost > 0 GROUP BY 1),
    s AS (SELECT product_id, SUM(total_sales_value) AS revenue, SUM(total_quantity) AS quantity FROM demand GROUP BY 1),
    x AS (SELECT s.*, unit_cost, revenue - ROUND(quantity * unit_cost, 2) AS gross FROM s LEFT JOIN g ON s.product_id = g.product_id)
    SELECT product_id, ROUND(revenue, 2) AS revenue, quantity, unit_cost, ROUND(gross, 2) AS gross_profit, ROUND(gross / revenue * 100, 1) AS margin_pct,
    CASE WHEN unit_cost IS NULL THEN 'COST_UNAVAILABLE' ELSE 'CALCULATED_FROM_AUDITED_COST' END AS profit_status FROM x""",
)
def _(t):
    return d.profit(d.demand_table(t.sales), costs_of(t))


_ORDERS = f"""{_VARIED}, {_COSTS}, g AS (SELECT product_id, ROUND(MIN_BY(unit_cost, city_name), 2) AS uc FROM costs WHERE unit_cost > 0 GROUP BY 1),
  q AS (SELECT product_id, city_name, SUM(procured_quantity) AS recommended_order_qty FROM sales GROUP BY 1, 2),
  orders_ AS (SELECT q.*, COALESCE(ROUND(c.unit_cost, 2), g.uc) AS unit_cost FROM q LEFT JOIN costs c ON q.product_id = c.product_id
    AND q.city_name = c.city_name AND c.unit_cost > 0 LEFT JOIN g ON q.product_id = g.product_id)"""


def _orders(t):
    quantities = t.sales.groupBy("product_id", "city_name").agg(F.sum(d.quantity()).alias("recommended_order_qty"))
    return cleaning.unit_cost(quantities, costs_of(t))


@query(
    "agg33_order_cost",
    f"""WITH {_ORDERS} SELECT product_id, city_name, recommended_order_qty, unit_cost, ROUND(recommended_order_qty * unit_cost, 2) AS total_order_cost,
    CASE WHEN unit_cost > 0 THEN 'VERIFIED_AUDIT_COST' ELSE 'NOT_AVAILABLE_IN_SOURCE' END AS cost_status FROM orders_""",
)
def _(t):
    return d.order_cost(_orders(t))


@query(
    "agg34_excess_value",
    f"""WITH {_ORDERS} SELECT product_id, city_name, recommended_order_qty AS current_stock, 150.0::DOUBLE AS target_stock_level, unit_cost,
    greatest(0.0, recommended_order_qty - 150.0) AS excess_quantity, ROUND(greatest(0.0, recommended_order_qty - 150.0) * unit_cost, 2) AS tied_up_value
    FROM orders_""",
)
def _(t):
    stock = _orders(t).withColumnRenamed("recommended_order_qty", "current_stock")
    return d.excess_value(stock.withColumn("target_stock_level", F.lit(150.0)))


@query(
    "agg35_fast_movers",
    f"""WITH {SALES}, {TABLE}, {PRODUCTS}, b AS (SELECT product_id, city_name, SUM(total_quantity) AS total_quantity,
      ROUND(SUM(total_sales_value), 2) AS total_revenue FROM demand GROUP BY 1, 2 ORDER BY total_quantity DESC, product_id, city_name LIMIT 50)
    SELECT b.*, product_name FROM b LEFT JOIN products p ON b.product_id = p.product_id""",
)
def _(t):
    return d.fast_movers(d.demand_table(t.sales), t.products, None, 50)


@query(
    "agg36_categories",
    f"""WITH {PRODUCTS} SELECT DISTINCT 'l0_category' AS level, l0_category AS category FROM products WHERE l0_category IS NOT NULL
    UNION SELECT 'l1_category', l1_category FROM products WHERE l1_category IS NOT NULL
    UNION SELECT 'l2_category', l2_category FROM products WHERE l2_category IS NOT NULL""",
)
def _(t):
    return d.categories(t.products)


@query("agg36_product_page", f"WITH {PRODUCTS} SELECT * FROM products ORDER BY product_id LIMIT 50 OFFSET 100")
def _(t):
    return d.page(t.products, [F.asc_nulls_last("product_id")], 100, 50)


@query("agg36_find_product", f"WITH {PRODUCTS} SELECT * FROM products WHERE product_id = 77")
def _(t):
    return d.find_product(t.products, 77)


@query(
    "agg38_demand_summary",
    f"""WITH {SALES}, {TABLE}, {PRODUCTS} SELECT (SELECT COUNT(*) FROM products) AS master_skus, COUNT(DISTINCT product_id) AS active_skus,
    COUNT(DISTINCT CAST(product_id AS VARCHAR) || city_name) AS series, COUNT(*) AS demand_rows, SUM(total_quantity) AS total_quantity,
    COUNT(DISTINCT CASE WHEN product_id NOT IN (SELECT product_id FROM products) THEN product_id END) AS unmatched_skus FROM demand""",
)
def _(t):
    return d.demand_summary(d.demand_table(t.sales), t.products)


@query(
    "agg39_daily_series",
    f"""WITH {SALES}, {TABLE} SELECT date_, product_id, city_name, total_quantity, order_count FROM demand WHERE city_name = 'ASIA'
    AND total_quantity <> 0 ORDER BY date_, product_id, city_name LIMIT 200 OFFSET 50""",
)
def _(t):
    rows = d.daily_series(d.demand_table(t.sales), city="asia", exclude_zeros=True, skip=50, limit=200)
    return rows.select("date_", "product_id", "city_name", "total_quantity", "order_count")
