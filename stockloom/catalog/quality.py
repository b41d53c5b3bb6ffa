"""Validation and data-quality queries (DQ-01 .. DQ-19, DQ-41)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.catalog.views import PRODUCTS, RAW, SALES, day, number
from stockloom.operators import profiling as p
from stockloom.operators import validation as v
from stockloom.schemas import SALES_COLUMNS

_COLS = ", ".join(SALES_COLUMNS)

VALIDATED = (
    RAW
    + ",\n"
    + PRODUCTS
    + f""",
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_COLS}) AS copy_no FROM raw),
parsed AS (
  SELECT n.*, {day('date_')} AS d, TRY_CAST({number('n.product_id')} AS BIGINT) AS pid,
    {number('procured_quantity')} AS q, {number('unit_selling_price')} AS pr,
    {number('total_discount_amount')} AS di, {number('total_weighted_landing_price')} AS co
  FROM numbered n),
validated AS (
  SELECT x.*, [e FOR e IN [
    CASE WHEN TRIM(date_) = '' THEN 'missing_date' END,
    CASE WHEN TRIM(date_) <> '' AND d IS NULL THEN 'invalid_date' END,
    CASE WHEN TRIM(x.product_id) = '' THEN 'missing_product_id' END,
    CASE WHEN TRIM(x.product_id) <> '' AND pid IS NULL THEN 'invalid_product_id' END,
    CASE WHEN pid IS NOT NULL AND m.product_id IS NULL THEN 'unmatched_product_id' END,
    CASE WHEN TRIM(procured_quantity) = '' THEN 'missing_quantity' END,
    CASE WHEN TRIM(procured_quantity) <> '' AND q IS NULL THEN 'invalid_quantity' END,
    CASE WHEN q < 0 THEN 'negative_quantity' END,
    CASE WHEN TRIM(unit_selling_price) = '' THEN 'missing_price' END,
    CASE WHEN TRIM(unit_selling_price) <> '' AND pr IS NULL THEN 'invalid_price' END,
    CASE WHEN pr < 0 THEN 'negative_price' END,
    CASE WHEN TRIM(total_discount_amount) = '' THEN 'missing_discount' END,
    CASE WHEN TRIM(total_discount_amount) <> '' AND di IS NULL THEN 'invalid_discount' END,
    CASE WHEN di < 0 THEN 'negative_discount' END,
    CASE WHEN copy_no > 1 THEN 'duplicate_row' END] IF e IS NOT NULL] AS errors
  FROM parsed x LEFT JOIN products m ON x.pid = m.product_id)"""
)


def _validated(t):
    return v.validate_rows(t.raw_sales, t.products)


@query(
    "dq01_required_columns",
    "SELECT 'unit_cost' AS missing_column, COUNT(*) AS row_count FROM lineitem"
    " UNION ALL SELECT 'warehouse_id', COUNT(*) FROM lineitem",
)
def _(t):
    absent = v.missing_columns(t.raw_sales, [*SALES_COLUMNS, "unit_cost", "warehouse_id"])
    rows = t.read("lineitem").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.select(F.explode(F.array(*[F.lit(c) for c in absent])).alias("missing_column"), "row_count")


@query(
    "dq02_parse_date",
    f"WITH {RAW} SELECT date_ AS source_text, {day('date_')} AS parsed_date, COUNT(*) AS row_count FROM raw GROUP BY 1, 2",
)
def _(t):
    raw = t.raw_sales.groupBy(F.col("date_").alias("source_text")).agg(F.count(F.lit(1)).alias("row_count"))
    return raw.withColumn("parsed_date", v.parse_date("source_text"))


@query(
    "dq03_parse_double",
    f"WITH {RAW} SELECT unit_selling_price AS source_text, {number('unit_selling_price')} AS parsed_value,"
    " COUNT(*) AS row_count FROM raw GROUP BY 1, 2",
)
def _(t):
    raw = t.raw_sales.groupBy(F.col("unit_selling_price").alias("source_text"))
    return raw.agg(F.count(F.lit(1)).alias("row_count")).withColumn("parsed_value", v.parse_double("source_text"))


@query(
    "dq04_parse_id",
    f"WITH {RAW} SELECT product_id AS source_text, TRY_CAST({number('product_id')} AS BIGINT) AS parsed_id,"
    " COUNT(*) AS row_count FROM raw GROUP BY 1, 2",
)
def _(t):
    raw = t.raw_sales.groupBy(F.col("product_id").alias("source_text"))
    return raw.agg(F.count(F.lit(1)).alias("row_count")).withColumn("parsed_id", v.parse_id("source_text"))


@query(
    "dq05_validate_rows",
    f"WITH {VALIDATED} SELECT array_to_string(errors, ',') AS errors, COUNT(*) AS row_count,"
    " MIN(order_id) AS first_order, MAX(order_id) AS last_order, CAST(COALESCE(SUM(pid), 0) AS BIGINT) AS id_sum"
    " FROM validated GROUP BY 1",
)
def _(t):
    rows = _validated(t)
    return rows.groupBy(F.array_join("errors", ",").alias("errors")).agg(
        F.sum("copies").alias("row_count"),
        F.min("order_id").alias("first_order"),
        F.max("order_id").alias("last_order"),
        F.coalesce(F.sum(F.col("parsed_product_id") * F.col("copies")), F.lit(0)).alias("id_sum"),
    )


@query(
    "dq06_first_seen_duplicates",
    "SELECT event_id, user_id, event_type, value, ROW_NUMBER() OVER (PARTITION BY user_id, event_type, value"
    " ORDER BY event_id) > 1 AS is_repeat FROM events",
)
def _(t):
    events = t.read("events").select("event_id", "user_id", "event_type", "value")
    return v.flag_repeats(events, ["user_id", "event_type", "value"], "event_id")


@query(
    "dq07_accepted_rows",
    f"WITH {VALIDATED} SELECT d AS date_, city_name, order_id, cart_id, dim_customer_key, q AS procured_quantity,"
    " pr AS unit_selling_price, di AS total_discount_amount, pid AS product_id, co AS total_weighted_landing_price"
    " FROM validated WHERE len(errors) = 0",
)
def _(t):
    return v.accepted(_validated(t))


@query(
    "dq07_rejected_rows",
    f"WITH {VALIDATED} SELECT {_COLS}, array_to_string(errors, ',') AS reasons, COUNT(*) AS copies"
    f" FROM validated WHERE len(errors) > 0 GROUP BY {_COLS}, 11",
)
def _(t):
    rows = v.rejected(_validated(t))
    return rows.withColumn("reasons", F.array_join("errors", ",")).drop("errors")


@query(
    "dq08_error_counts",
    f"WITH {VALIDATED}, codes AS (SELECT UNNEST({v.ERROR_CODES!r}) AS error_code) SELECT error_code,"
    " (SELECT COUNT(*) FROM validated WHERE list_contains(errors, error_code)) AS row_count FROM codes",
)
def _(t):
    return v.error_counts(_validated(t))


def _checks_sql(where: str = "") -> str:
    """The seven checks over ``validated``, as long rows."""

    def n(code):
        return f"COUNT(*) FILTER (list_contains(errors, '{code}'))"

    parts = [
        "SELECT 0 AS check_order, 'required_columns' AS check_name, 'PASS' AS status,"
        " 'All required columns are present.' AS details FROM (SELECT COUNT(*) FROM validated)"
    ]
    for i, (check, codes) in enumerate(v.CHECKS.items(), start=1):
        if check == "date_validation":
            labels = ["Missing dates", "Invalid dates"]
        elif check == "duplicate_validation":
            labels = ["Duplicate rows"]
        else:
            labels = [c.split("_")[0].capitalize() for c in codes]
        details = " || '; ' || ".join(f"'{label}: ' || {n(c)}" for label, c in zip(labels, codes))
        bad = "WARNING" if check == "duplicate_validation" else "FAIL"
        found = " + ".join(n(c) for c in codes)
        parts.append(
            f"SELECT {i}, '{check}', CASE WHEN {found} = 0 THEN 'PASS' ELSE '{bad}' END, {details} FROM validated {where}"
        )
    return " UNION ALL ".join(parts)


@query("dq09_check_summary", f"WITH {VALIDATED} {_checks_sql()}")
def _(t):
    return v.check_summary(_validated(t))


_STATUS_SQL = """CASE WHEN COUNT(*) FILTER (len(errors) = 0) > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  COUNT(*) AS total_rows, COUNT(*) FILTER (len(errors) = 0) AS processed_rows,
  COUNT(*) FILTER (len(errors) > 0) AS invalid_rows,
  CASE WHEN COUNT(*) FILTER (len(errors) = 0) = 0 THEN 'No valid sales rows were found.' END AS error_summary"""


@query("dq10_job_status", f"WITH {VALIDATED} SELECT {_STATUS_SQL} FROM validated")
def _(t):
    return v.job_status(_validated(t))


@query(
    "dq11_unmatched_sample",
    f"WITH {VALIDATED} SELECT DISTINCT pid AS product_id FROM validated"
    " WHERE list_contains(errors, 'unmatched_product_id') ORDER BY pid LIMIT 20",
)
def _(t):
    return v.unmatched_sample(_validated(t))


_FILE_SQL = (
    RAW
    + ",\n"
    + PRODUCTS
    + f""",
numbered AS (SELECT 'sales_' || lower(city_name) AS source_file, *, ROW_NUMBER() OVER (PARTITION BY {_COLS}) AS c FROM raw),
typed AS (
  SELECT n.*, {day('date_')} AS day, NULLIF(TRIM(n.product_id), '') AS pid, {number('procured_quantity')} AS q,
    {number('unit_selling_price')} AS p, {number('total_discount_amount')} AS d,
    m.product_id IS NOT NULL AS known
  FROM numbered n LEFT JOIN products m ON NULLIF(TRIM(n.product_id), '') = CAST(m.product_id AS VARCHAR)),
report AS (
  SELECT source_file, COUNT(*) AS row_count, COUNT(DISTINCT order_id) AS unique_orders,
    COUNT(DISTINCT cart_id) AS unique_carts, COUNT(DISTINCT dim_customer_key) AS unique_customers,
    COUNT(DISTINCT pid) AS unique_products, MIN(day) AS date_min, MAX(day) AS date_max,
    COUNT(*) FILTER (TRIM(date_) <> '' AND day IS NULL) AS date_parse_failures,
    COUNT(*) FILTER (TRIM(date_) = '') AS missing_date, COUNT(*) FILTER (pid IS NULL) AS missing_product_id,
    COUNT(*) FILTER (q IS NULL) AS missing_quantity, COUNT(*) FILTER (p IS NULL) AS missing_price,
    COUNT(*) FILTER (d IS NULL) AS missing_discount, COUNT(*) FILTER (q < 0) AS negative_quantity,
    COUNT(*) FILTER (q = 0) AS zero_quantity, COUNT(*) FILTER (p < 0) AS negative_price,
    COUNT(*) FILTER (p = 0) AS zero_price, COUNT(*) FILTER (d < 0) AS negative_discount,
    COUNT(*) FILTER (c > 1) AS duplicate_rows, ROUND(COALESCE(SUM(q), 0.0), 2) AS quantity_sum,
    ROUND(COALESCE(SUM(q * p), 0.0), 2) AS gross_sales_value, ROUND(COALESCE(SUM(d), 0.0), 2) AS discount_sum,
    ROUND(COALESCE(SUM(q * p - d), 0.0), 2) AS net_sales_estimate,
    COUNT(pid) AS ids_checked, COUNT(*) FILTER (known) AS ids_matched
  FROM typed GROUP BY 1),
reports AS (
  SELECT *, ids_checked - ids_matched AS ids_unmatched, ROUND(ids_matched / ids_checked, 6) AS match_rate,
    CASE WHEN row_count = 0 THEN 'FAIL - EMPTY' WHEN date_parse_failures > 0 THEN 'REVIEW - DATE PARSING'
      WHEN missing_product_id > 0 THEN 'REVIEW - MISSING PRODUCT IDS'
      WHEN missing_quantity > 0 THEN 'REVIEW - MISSING QUANTITY' WHEN missing_price > 0 THEN 'REVIEW - MISSING PRICE'
      WHEN negative_quantity > 0 THEN 'REVIEW - NEGATIVE QUANTITY'
      WHEN negative_price > 0 THEN 'REVIEW - NEGATIVE PRICE' ELSE 'PASS - BASIC QUALITY' END AS data_quality_status
  FROM report)"""
)


def _files(t):
    tagged = t.raw_sales.withColumn("source_file", F.concat(F.lit("sales_"), F.lower("city_name")))
    return p.file_report(tagged, t.products)


@query("dq12_file_report", f"WITH {_FILE_SQL} SELECT * EXCLUDE (data_quality_status) FROM reports")
def _(t):
    return _files(t).drop("data_quality_status")


@query("dq13_file_verdict", f"WITH {_FILE_SQL} SELECT source_file, data_quality_status FROM reports")
def _(t):
    return _files(t).select("source_file", "data_quality_status")


@query(
    "dq14_overall_report",
    f"""WITH {_FILE_SQL} SELECT CAST(8 AS BIGINT) AS expected_files, COUNT(*) AS files_found, 8 - COUNT(*) AS files_missing,
    CAST(SUM(row_count) AS BIGINT) AS rows_found, CAST(SUM(unique_products) AS BIGINT) AS unique_products_sum,
    ROUND(SUM(ids_matched) / SUM(ids_checked), 6) AS overall_match_rate, MIN(date_min) AS overall_date_min,
    MAX(date_max) AS overall_date_max, ROUND(SUM(quantity_sum), 2) AS total_quantity,
    ROUND(SUM(gross_sales_value), 2) AS gross_sales_value, ROUND(SUM(discount_sum), 2) AS total_discount,
    ROUND(SUM(net_sales_estimate), 2) AS net_sales_estimate FROM reports""",
)
def _(t):
    return p.overall_report(_files(t), 8)


@query(
    "dq15_dataset_report",
    f"""WITH {_FILE_SQL}, r AS (SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (c > 1) AS duplicate_rows,
    COUNT(DISTINCT pid) AS unique_products, MIN(day) AS min_date, MAX(day) AS max_date,
    COUNT(*) FILTER (day IS NULL) AS missing_dates, COUNT(*) FILTER (pid IS NULL) AS missing_product_ids,
    COUNT(*) FILTER (q < 0) AS negative_quantities, COUNT(*) FILTER (p < 0) AS negative_prices,
    ROUND(COUNT(*) FILTER (known) / COUNT(pid) * 100, 2) AS match_rate_pct FROM typed)
    SELECT *, CASE WHEN missing_dates + missing_product_ids + negative_quantities + negative_prices > 0
      THEN 'WARNINGS' ELSE 'PASS' END AS status FROM r""",
)
def _(t):
    return p.dataset_report(t.raw_sales, t.products)


@query(
    "dq16_match_rate",
    f"WITH {_FILE_SQL} SELECT COUNT(pid) AS checked, COUNT(*) FILTER (known) AS matched,"
    " ROUND(COUNT(*) FILTER (known) / COUNT(pid), 6) AS match_rate FROM typed",
)
def _(t):
    return p.match_rate(t.raw_sales, t.products)


@query(
    "dq17_null_profile",
    f"""WITH {SALES}, {PRODUCTS}, e AS (SELECT s.*, p.product_name, p.brand_name, p.l0_category FROM sales s
    LEFT JOIN products p ON s.product_id = p.product_id),
    c AS (SELECT COUNT(*) - COUNT(total_weighted_landing_price) AS total_weighted_landing_price,
      COUNT(*) - COUNT(product_name) AS product_name, COUNT(*) - COUNT(brand_name) AS brand_name,
      COUNT(*) - COUNT(l0_category) AS l0_category, COUNT(*) - COUNT(product_id) AS product_id,
      COUNT(*) - COUNT(date_) AS date_ FROM e)
    SELECT column_name, null_count FROM (UNPIVOT c ON COLUMNS(*) INTO NAME column_name VALUE null_count)
    WHERE null_count > 0""",
)
def _(t):
    attributes = t.products.select("product_id", "product_name", "brand_name", "l0_category")
    return p.null_profile(t.sales.join(attributes, "product_id", "left"))


_PROFILED = ["order_id", "dim_customer_key", "product_id", "city_name", "date_"]


@query(
    "dq18_distinct_profile",
    f"WITH {SALES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM sales" for c in _PROFILED
    ),
)
def _(t):
    return p.distinct_profile(t.sales, _PROFILED)


def _audit_sql(c: str, limit, median: bool) -> str:
    extreme = f"COUNT(*) FILTER ({c} > {limit})" if limit is not None else "CAST(0 AS BIGINT)"
    med = f"ROUND(MEDIAN({c}), 4)" if median else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{c}' AS measure, COUNT(*) - COUNT({c}) AS null_rows, COUNT(*) FILTER ({c} < 0) AS negative_rows,"
        f" COUNT(*) FILTER ({c} = 0) AS zero_rows, {extreme} AS extreme_rows, MIN({c}) AS min_value,"
        f" MAX({c}) AS max_value, ROUND(AVG({c}), 4) AS avg_value, {med} AS median_value FROM sales"
    )


@query(
    "dq19_numeric_audit",
    f"WITH {SALES} "
    + " UNION ALL ".join(
        _audit_sql(c, limit, c in ("procured_quantity", "unit_selling_price")) for c, limit in p.EXTREMES.items()
    ),
)
def _(t):
    return p.numeric_audit(t.sales)


def _jobs(t):
    """One upload job per city."""
    validated = _validated(t)
    status = v.job_status(validated, ["city_name"])
    started = validated.groupBy("city_name").agg(F.max("parsed_date").alias("created_at"))
    return status.join(started, "city_name").withColumnRenamed("city_name", "job_id")


@query(
    "dq41_job_history",
    f"WITH {VALIDATED} SELECT city_name AS job_id, {_STATUS_SQL}, MAX(d) AS created_at FROM validated GROUP BY 1",
)
def _(t):
    return v.job_history(_jobs(t))


_ASIA = "WHERE city_name = 'ASIA'"


@query(
    "dq41_job_checks",
    f"WITH {VALIDATED} SELECT 'ASIA' AS job_id, * FROM ({_checks_sql(_ASIA)})",
)
def _(t):
    checks = v.check_summary(_validated(t), ["city_name"]).withColumnRenamed("city_name", "job_id")
    return v.job_checks(checks, "ASIA")
