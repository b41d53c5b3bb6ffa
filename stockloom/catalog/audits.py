"""Audit queries (DQ-20 .. DQ-40)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.catalog.views import FIRST_DAY, LAST_DAY, ENRICHED, LINES, PANEL, PRODUCTS, SALES, grid
from stockloom.functions.scalars import month_label
from stockloom.operators import audits as a
from stockloom.operators import cleaning, demand
from stockloom.operators import profiling as p
from stockloom.session import scratch_path


def _odd_sales(t):
    """Sales with zero quantities, zero prices and too large discounts among them."""
    line = F.col("order_id") % 19
    return t.sales.withColumns(
        {
            "procured_quantity": F.when(line == 0, F.lit(0.0)).otherwise(F.col("procured_quantity")),
            "unit_selling_price": F.when(line == 1, F.lit(0.0)).otherwise(F.col("unit_selling_price")),
            "total_discount_amount": F.when(line == 2, F.col("total_discount_amount") * 50).otherwise(
                F.col("total_discount_amount")
            ),
        }
    )


_ODD = SALES + """, odd AS (SELECT * REPLACE (
  CASE WHEN order_id % 19 = 0 THEN 0.0 ELSE procured_quantity END AS procured_quantity,
  CASE WHEN order_id % 19 = 1 THEN 0.0 ELSE unit_selling_price END AS unit_selling_price,
  CASE WHEN order_id % 19 = 2 THEN total_discount_amount * 50 ELSE total_discount_amount END AS total_discount_amount)
  FROM sales)"""


@query(
    "dq20_suspicious_counts",
    f"""WITH {_ODD} SELECT COUNT(*) FILTER (procured_quantity > 0 AND unit_selling_price = 0) AS sold_at_zero_price,
    COUNT(*) FILTER (procured_quantity = 0 AND unit_selling_price > 0) AS priced_without_quantity,
    COUNT(*) FILTER (total_discount_amount > procured_quantity * unit_selling_price AND procured_quantity > 0
      AND unit_selling_price > 0) AS discount_exceeds_value FROM odd""",
)
def _(t):
    return a.suspicious_counts(_odd_sales(t))


@query(
    "dq21_extreme_prices",
    f"""WITH {SALES} SELECT product_id, date_, city_name, unit_selling_price,
    procured_quantity FROM sales WHERE unit_selling_price > 5000
    ORDER BY sales.unit_selling_price DESC, product_id, date_, city_name, procured_quantity LIMIT 20""",
)
def _(t):
    return a.extreme_rows(t.sales, 5000, 20)


@query(
    "dq22_duplicate_groups",
    """SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def _(t):
    return a.duplicate_groups(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dq23_duplicate_count",
    """SELECT (SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem) AS exact_rows,
    (SELECT COUNT(*) - COUNT(DISTINCT l_orderkey) FROM lineitem) AS order_keys""",
)
def _(t):
    lines = t.read("lineitem")
    by_key = a.duplicate_count(lines, ["l_orderkey"]).scalar()
    return a.duplicate_count(lines).select(F.col("duplicate_rows").alias("exact_rows"), by_key.alias("order_keys"))


@query(
    "dq24_temporal_audit",
    f"""WITH {LINES}, s AS (SELECT CASE WHEN l_partkey % 53 = 0 THEN '' WHEN l_partkey % 59 = 0 THEN '2000-31-31'
      ELSE strftime(order_date, '%Y-%m-%d') END AS date_ FROM lines),
    x AS (SELECT NULLIF(TRIM(date_), '') AS text, TRY_CAST(NULLIF(TRIM(date_), '') AS DATE) AS d FROM s)
    SELECT MIN(d) AS min_date, MAX(d) AS max_date, COUNT(DISTINCT d) AS unique_dates,
    COUNT(*) FILTER (text IS NULL) AS null_dates, COUNT(*) FILTER (text IS NOT NULL AND d IS NULL) AS invalid_dates,
    COUNT(*) FILTER (d > DATE '2000-12-31') AS after_range, COUNT(*) FILTER (d < DATE '1996-01-01') AS before_range
    FROM x""",
)
def _(t):
    part = F.col("l_partkey")
    text = (
        F.when(part % 53 == 0, F.lit(""))
        .when(part % 59 == 0, F.lit("2000-31-31"))
        .otherwise(F.date_format("order_date", "yyyy-MM-dd"))
    )
    return p.temporal_audit(t.lines.select(text.alias("date_")), "1996-01-01", "2000-12-31")


@query(
    "dq25_month_coverage",
    f"""WITH {SALES} SELECT strftime(date_, '%Y-%m') AS month, COUNT(*) AS row_count, COUNT(DISTINCT product_id) AS products,
    COUNT(DISTINCT city_name) AS cities, COUNT(DISTINCT date_) AS days FROM sales GROUP BY 1""",
)
def _(t):
    return p.coverage(t.sales.withColumn("month", month_label("date_")), ["month"])


@query(
    "dq25_city_month_coverage",
    f"""WITH {SALES} SELECT city_name, strftime(date_, '%Y-%m') AS month, COUNT(*) AS row_count,
    COUNT(DISTINCT product_id) AS products, COUNT(DISTINCT date_) AS days FROM sales GROUP BY 1, 2""",
)
def _(t):
    return p.coverage(t.sales.withColumn("month", month_label("date_")), ["city_name", "month"]).drop("cities")


@query(
    "dq26_grain_violations",
    f"""WITH {SALES} SELECT date_, product_id, city_name, COUNT(*) AS row_count FROM sales GROUP BY 1, 2, 3
    HAVING COUNT(*) > 1""",
)
def _(t):
    return a.grain_violations(t.sales)


@query(
    "dq27_reconcile",
    f"""WITH {SALES}, stored AS (SELECT date_, product_id, city_name, SUM(procured_quantity) + CASE WHEN product_id % 97 = 0 THEN 1 ELSE 0 END AS quantity,
      SUM(procured_quantity * unit_selling_price) AS revenue FROM sales GROUP BY 1, 2, 3),
    s AS (SELECT SUM(procured_quantity) AS sq, SUM(procured_quantity * unit_selling_price) AS sr FROM sales),
    d AS (SELECT SUM(quantity) AS dq, SUM(revenue) AS dr FROM stored)
    SELECT ROUND(sq, 2) AS sales_quantity, ROUND(dq, 2) AS demand_quantity, ROUND(sr, 2) AS sales_revenue, ROUND(dr, 2) AS demand_revenue,
    abs(sq - dq) < 1 AS quantity_match, abs(sr - dr) < 1 AS revenue_match FROM s, d""",
)
def _(t):
    # The stored table has one piece too many wherever 97 divides the product.
    daily = demand.daily_demand(t.sales)
    extra = F.when(F.col("product_id") % 97 == 0, 1).otherwise(0)
    path = scratch_path(t.spark, "stored-demand")
    daily.withColumn("daily_quantity", F.col("daily_quantity") + extra).write.parquet(path)
    return a.reconcile(t.sales, t.spark.read.parquet(path))


@query(
    "dq28_expectations",
    f"""WITH {ENRICHED}, x AS (SELECT CAST(COUNT(*) AS DOUBLE) AS total_rows, CAST(COUNT(*) - COUNT(date_) AS DOUBLE) AS null_dates,
    CAST(COUNT(*) FILTER (procured_quantity < 0) AS DOUBLE) AS negative_quantity,
    CAST(COUNT(*) - COUNT(product_name) AS DOUBLE) AS missing_names FROM enriched)
    SELECT 'negative_quantity' AS name, 0.0::DOUBLE AS expected, negative_quantity AS actual, negative_quantity = 0 AS ok FROM x
    UNION ALL SELECT 'null_dates', 0.0, null_dates, null_dates = 0 FROM x
    UNION ALL SELECT 'missing_names', 0.0, missing_names, missing_names = 0 FROM x""",
)
def _(t):
    return a.expectations(
        cleaning.enrich(t.sales, t.products),
        {
            "negative_quantity": (F.count_if(F.col("procured_quantity") < 0), 0),
            "null_dates": (F.count_if(F.col("date_").isNull()), 0),
            "missing_names": (F.count_if(F.col("product_name").isNull()), 0),
        },
    )


@query(
    "dq29_dependency_violations",
    "SELECT p_name, COUNT(DISTINCT p_type) AS values FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_type) > 1",
)
def _(t):
    return a.fd_violations(t.read("part"), "p_name", "p_type")


_PAIRS = [("p_partkey", "p_name"), ("p_type", "p_name"), ("p_name", "p_size"), ("p_brand", "p_type")]


@query(
    "dq29_dependency_summary",
    " UNION ALL ".join(
        f"SELECT '{l} -> {r}' AS dependency, COUNT(*) AS groups, COUNT(*) FILTER (v > 1) AS violations"
        f" FROM (SELECT {l}, COUNT(DISTINCT {r}) AS v FROM part GROUP BY 1)"
        for l, r in _PAIRS
    ),
)
def _(t):
    return a.fd_summary(t.read("part"), _PAIRS)


@query(
    "dq30_order_count_check",
    f"""WITH {SALES}, exact AS (SELECT date_, product_id, city_name, COUNT(DISTINCT order_id) AS exact, COUNT(*) AS order_count
    FROM sales GROUP BY 1, 2, 3)
    SELECT COUNT(*) AS rows_compared, CAST(0 AS BIGINT) AS only_in_sales, CAST(0 AS BIGINT) AS only_in_demand,
    COUNT(*) FILTER (order_count <> exact) AS mismatched,
    COUNT(*) FILTER (order_count > exact) AS overcounted, COUNT(*) FILTER (order_count < exact) AS undercounted,
    MAX(order_count - exact) AS max_overcount, CAST(SUM(order_count) AS BIGINT) AS stored_total,
    CAST(SUM(exact) AS BIGINT) AS exact_total FROM exact""",
)
def _(t):
    # A per-chunk count as the stored value: every line counts as one order.
    stored = t.sales.groupBy("date_", "product_id", "city_name").agg(F.count(F.lit(1)).alias("order_count"))
    return a.verify_order_count(t.sales, stored)


_ACTIVE = "active AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem)"


def _active(t):
    return t.read("lineitem").select(F.col("l_partkey").alias("product_id"))


@query(
    "dq31_compare_keys",
    f"""WITH {PRODUCTS}, {_ACTIVE} SELECT COUNT(*) FILTER (b.product_id IS NULL) AS only_left,
    COUNT(*) FILTER (a.product_id IS NULL) AS only_right,
    COUNT(*) FILTER (a.product_id IS NOT NULL AND b.product_id IS NOT NULL) AS in_both
    FROM (SELECT product_id FROM products WHERE product_id IS NOT NULL) a FULL JOIN active b ON a.product_id = b.product_id""",
)
def _(t):
    return a.compare_keys(t.products, _active(t), "product_id")


@query(
    "dq32_compare_fields",
    f"""WITH {PRODUCTS}, other AS (SELECT product_id, CASE WHEN product_id % 9 = 0 THEN NULL
      WHEN product_id % 7 = 0 THEN upper(product_name) ELSE product_name END AS product_name, brand_name FROM products),
    j AS (SELECT a.product_name AS an, b.product_name AS bn, a.brand_name AS ab, b.brand_name AS bb
      FROM products a JOIN other b ON a.product_id = b.product_id)
    SELECT 'product_name' AS column_name, COUNT(*) FILTER (an IS NOT NULL AND bn IS NOT NULL) AS compared,
      COUNT(*) FILTER (an <> bn) AS mismatches FROM j
    UNION ALL SELECT 'brand_name', COUNT(*) FILTER (ab IS NOT NULL AND bb IS NOT NULL), COUNT(*) FILTER (ab <> bb) FROM j""",
)
def _(t):
    pid = F.col("product_id")
    other = t.products.withColumn(
        "product_name", F.when(pid % 9 == 0, None).when(pid % 7 == 0, F.upper("product_name")).otherwise(F.col("product_name"))
    )
    return a.compare_fields(t.products, other, "product_id", ["product_name", "brand_name"])


_PROFILE = f"""{ENRICHED}, profile AS (SELECT product_id, COUNT(*) AS total_rows, SUM(procured_quantity) AS total_qty,
    ROUND(SUM(procured_quantity * unit_selling_price), 2) AS total_revenue, MIN(date_) AS first_date, MAX(date_) AS last_date,
    COUNT(DISTINCT date_) AS active_days, COUNT(DISTINCT city_name) AS num_cities,
    STRING_AGG(DISTINCT city_name, ', ' ORDER BY city_name) AS cities,
    COUNT(DISTINCT strftime(date_, '%Y-%m')) AS num_months,
    array_to_string(list_sort(list(DISTINCT strftime(date_, '%Y-%m'))), ', ') AS months,
    MIN(unit_selling_price) AS min_price, MAX(unit_selling_price) AS max_price,
    ROUND(AVG(unit_selling_price), 6) AS avg_price, ROUND(STDDEV_SAMP(unit_selling_price), 6) AS std_price,
    MIN(procured_quantity) AS min_qty, MAX(procured_quantity) AS max_qty, ROUND(AVG(procured_quantity), 6) AS avg_qty,
    ROUND(MEDIAN(unit_selling_price), 8) AS median_price
    FROM enriched WHERE product_name IS NULL GROUP BY 1)"""


@query("dq33_unmatched_profile", f"WITH {_PROFILE} SELECT * FROM profile")
def _(t):
    return a.unmatched_profile(cleaning.enrich(t.sales, t.products))


@query(
    "dq34_classify_unmatched",
    f"""WITH {_PROFILE} SELECT CASE WHEN total_rows >= 50 AND num_cities >= 2 AND num_months >= 2 THEN 'A_recurring_strong_evidence'
    WHEN total_rows >= 10 AND (num_cities >= 2 OR num_months >= 2) THEN 'A_recurring_moderate_evidence'
    WHEN total_rows >= 5 THEN 'B_low_frequency'
    WHEN total_rows >= 2 THEN CASE WHEN min_price = 0 AND max_price = 0 THEN 'C_suspicious_anomalous' ELSE 'B_low_frequency' END
    WHEN total_qty = 0 OR (min_price = 0 AND max_price = 0) THEN 'C_suspicious_anomalous'
    ELSE 'D_unresolved_single_occurrence' END AS classification, COUNT(*) AS products,
    CAST(SUM(total_rows) AS BIGINT) AS row_count FROM profile GROUP BY 1""",
)
def _(t):
    classified = a.classify_unmatched(a.unmatched_profile(cleaning.enrich(t.sales, t.products)))
    return classified.groupBy("classification").agg(
        F.count(F.lit(1)).alias("products"), F.sum("total_rows").alias("row_count")
    )


@query(
    "dq35_sku_match",
    f"""WITH {PRODUCTS}, s AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem)
    SELECT COUNT(*) AS total_sales_skus, COUNT(r.p_partkey) AS matched_raw_skus, COUNT(c.product_id) AS matched_clean_skus,
    COUNT(*) FILTER (r.p_partkey IS NULL AND c.product_id IS NULL) AS unmatched_skus
    FROM s LEFT JOIN (SELECT CASE WHEN p_size > 10 THEN p_partkey END AS p_partkey FROM part) r ON s.product_id = r.p_partkey
    LEFT JOIN products c ON s.product_id = c.product_id""",
)
def _(t):
    sales = t.read("lineitem").select(F.col("l_partkey").alias("product_id"))
    raw = t.read("part").select(F.when(F.col("p_size") > 10, F.col("p_partkey")).alias("product_id"))
    return a.sku_match(sales, raw, t.products)


_GAPS = f"""{SALES}, pc AS (SELECT product_id, city_name, COUNT(*) FILTER (total_weighted_landing_price IS NULL) AS missing,
    COUNT(total_weighted_landing_price) AS known FROM sales GROUP BY 1, 2),
    pp AS (SELECT product_id, SUM(missing) AS missing, SUM(known) AS known FROM pc GROUP BY 1)"""


@query(
    "dq36_cost_audit",
    f"""WITH {_GAPS} SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (total_weighted_landing_price IS NULL) AS missing_cost,
    COUNT(*) FILTER (total_weighted_landing_price = 0) AS zero_cost, COUNT(*) FILTER (total_weighted_landing_price < 0) AS negative_cost,
    COUNT(*) FILTER (total_weighted_landing_price > 10000) AS extreme_cost,
    (SELECT COUNT(*) FROM pp WHERE missing > 0) AS products_with_missing_cost,
    (SELECT COUNT(*) FROM pp WHERE missing > 0 AND known > 0) AS products_with_history,
    (SELECT COUNT(*) FROM pp WHERE missing > 0 AND known = 0) AS products_without_history FROM sales""",
)
def _(t):
    return a.cost_audit(t.sales)


@query(
    "dq36_cost_gaps_by_month",
    f"""WITH {SALES} SELECT strftime(date_, '%Y-%m') AS month, COUNT(*) AS missing_rows FROM sales
    WHERE total_weighted_landing_price IS NULL GROUP BY 1""",
)
def _(t):
    return a.cost_gaps_by(t.sales, month_label("date_"), "month")


@query(
    "dq36_cost_gaps_by_city",
    f"""WITH {SALES} SELECT city_name, COUNT(*) AS missing_rows FROM sales WHERE total_weighted_landing_price IS NULL GROUP BY 1""",
)
def _(t):
    return a.cost_gaps_by(t.sales, F.col("city_name"), "city_name")


@query(
    "dq37_cost_recoverability",
    f"""WITH {_GAPS} SELECT CAST(SUM(CASE WHEN pc.known > 0 THEN pc.missing ELSE 0 END) AS BIGINT) AS series_recoverable,
    CAST(SUM(CASE WHEN pc.known = 0 THEN pc.missing ELSE 0 END) AS BIGINT) AS series_not_recoverable,
    CAST(SUM(CASE WHEN pp.known > 0 THEN pc.missing ELSE 0 END) AS BIGINT) AS product_recoverable,
    CAST(SUM(CASE WHEN pp.known = 0 THEN pc.missing ELSE 0 END) AS BIGINT) AS product_not_recoverable
    FROM pc JOIN pp ON pc.product_id = pp.product_id""",
)
def _(t):
    return a.cost_recoverability(t.sales)


@query(
    "dq37_unresolvable_costs",
    f"""WITH {LINES}, s AS (SELECT *, CASE WHEN l_partkey % 11 = 0 OR l_returnflag = 'R' THEN NULL ELSE p_retailprice END AS c FROM lines)
    SELECT l_partkey AS product_id, COUNT(*) AS missing_rows FROM s GROUP BY 1 HAVING COUNT(c) = 0""",
)
def _(t):
    cost = F.when(F.col("product_id") % 11 != 0, F.col("total_weighted_landing_price"))
    return a.unresolvable_costs(t.sales.withColumn("total_weighted_landing_price", cost))


@query(
    "dq38_external_coverage",
    """WITH days AS (SELECT CAST(o_orderdate AS DATE) AS date_, o_orderpriority AS city_name, AVG(o_totalprice) AS reading
    FROM orders GROUP BY 1, 2), k AS (SELECT COUNT(*) AS n, COUNT(DISTINCT date_) AS dd, MIN(date_) AS lo, MAX(date_) AS hi FROM days)
    SELECT n AS row_count, CAST(DATE '2001-08-01' - DATE '1995-01-01' + 1 AS BIGINT) AS expected_days, dd AS actual_days, lo AS start_date,
    hi AS end_date, CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS missing_values,
    dd = DATE '2001-08-01' - DATE '1995-01-01' + 1 AND lo = DATE '1995-01-01' AND hi = DATE '2001-08-01' AS coverage_complete FROM k""",
)
def _(t):
    days = t.read("orders").groupBy(F.to_date("o_orderdate").alias("date_"), F.col("o_orderpriority").alias("city_name"))
    readings = days.agg(F.avg("o_totalprice").alias("reading"))
    return p.external_coverage(readings, ["date_", "city_name"], "1995-01-01", "2001-08-01")


@query(
    "dq38_rows_per_city",
    """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_, o_orderpriority AS city_name FROM orders)
    SELECT city_name, COUNT(*) AS row_count FROM days GROUP BY 1""",
)
def _(t):
    days = t.read("orders").select(F.to_date("o_orderdate").alias("date_"), F.col("o_orderpriority").alias("city_name"))
    return p.rows_per(days.distinct(), "city_name")


@query(
    "dq39_ledger_check",
    f"""WITH {PANEL}, {grid('panel', FIRST_DAY, LAST_DAY)}, ledger AS (SELECT product_id, city_name, date_ AS snapshot_date,
      100.0 AS opening_stock, CASE WHEN dayofmonth(date_) % 10 = 0 THEN 40.0 ELSE 0.0 END AS stock_received,
      daily_quantity AS sales_quantity FROM grid),
    c AS (SELECT *, CASE WHEN dayofmonth(snapshot_date) = 15 THEN 90.0
      ELSE greatest(0.0, opening_stock + stock_received - sales_quantity) END AS closing_stock FROM ledger)
    SELECT product_id, city_name, snapshot_date, closing_stock, greatest(0.0, opening_stock + stock_received - sales_quantity) AS expected_closing
    FROM c WHERE abs(closing_stock - greatest(0.0, opening_stock + stock_received - sales_quantity)) > 1e-6""",
)
def _(t):
    moves = t.movements
    true_close = F.greatest(F.lit(0.0), F.lit(100.0) + F.col("stock_received") - F.col("sales_quantity"))
    ledger = moves.withColumns(
        {
            "opening_stock": F.lit(100.0),
            "closing_stock": F.when(F.dayofmonth("snapshot_date") == 15, 90.0).otherwise(true_close),
        }
    )
    return a.ledger_check(ledger).select("product_id", "city_name", "snapshot_date", "closing_stock", "expected_closing")


@query("dq40_vocabulary", "SELECT DISTINCT upper(trim(p_brand)) AS term FROM part WHERE upper(trim(p_brand)) <> 'BRAND#7'")
def _(t):
    return p.vocabulary(t.read("part"), "p_brand", sentinel="BRAND#7")
