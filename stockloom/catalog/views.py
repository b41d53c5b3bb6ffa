"""SQL text of the shared views, for the reference queries."""

from __future__ import annotations

LINES = """lines AS (
  SELECT l.*, o.o_custkey, CAST(o.o_orderdate AS DATE) AS order_date, r.r_name, p.p_retailprice, p.p_type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SALES = LINES + """,
sales AS (
  SELECT order_date AS date_, r_name AS city_name, l_orderkey AS order_id, l_orderkey AS cart_id,
    o_custkey AS dim_customer_key, l_quantity AS procured_quantity,
    l_extendedprice / l_quantity AS unit_selling_price,
    l_extendedprice * l_discount AS total_discount_amount, l_partkey AS product_id,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE p_retailprice END AS total_weighted_landing_price
  FROM lines)"""

PRODUCTS = """products AS (
  SELECT CASE WHEN p_partkey % 50 <> 0 THEN p_partkey END AS product_id, p_name AS product_name, p_brand AS brand_name,
    p_type AS l0_category, p_name AS l1_category, CAST(p_size AS VARCHAR) AS l2_category
  FROM part)"""

ENRICHED = SALES + ",\n" + PRODUCTS + """,
enriched AS (
  SELECT s.*, p.product_name, p.brand_name, p.l0_category, p.l1_category, p.l2_category
  FROM sales s LEFT JOIN products p ON s.product_id = p.product_id)"""

RAW = LINES + """,
raw_once AS (
  SELECT l_discount,
    CASE WHEN l_partkey % 53 = 0 THEN '' WHEN l_partkey % 59 = 0 THEN '31-31-2000'
      WHEN l_linenumber = 2 THEN strftime(order_date, '%d-%m-%Y')
      WHEN l_linenumber = 3 THEN strftime(order_date, '%Y/%m/%d')
      WHEN l_linenumber = 4 THEN strftime(order_date, '%d/%m/%Y')
      ELSE strftime(order_date, '%Y-%m-%d') END AS date_,
    r_name AS city_name, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_orderkey AS VARCHAR) AS cart_id,
    CAST(o_custkey AS VARCHAR) AS dim_customer_key,
    CASE WHEN l_suppkey % 31 = 0 THEN ' ' WHEN l_suppkey % 37 = 0 THEN 'n/a'
      WHEN l_linenumber = 1 AND l_partkey % 97 = 0 THEN '-' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
      ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) END AS procured_quantity,
    CASE WHEN l_suppkey % 41 = 0 THEN ' ' WHEN l_suppkey % 43 = 0 THEN 'nan'
      WHEN l_linenumber = 1 AND l_partkey % 89 = 0
        THEN '-' || CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS VARCHAR)
      ELSE CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS VARCHAR) END AS unit_selling_price,
    CASE WHEN l_suppkey % 47 = 0 THEN ' ' WHEN l_suppkey % 23 = 0 THEN '1,5'
      WHEN l_linenumber = 1 AND l_partkey % 83 = 0
        THEN '-' || CAST(CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS VARCHAR)
      ELSE CAST(CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS VARCHAR) END AS total_discount_amount,
    CASE WHEN l_partkey % 61 = 0 THEN '' WHEN l_partkey % 67 = 0 THEN 'P' || CAST(l_partkey AS VARCHAR)
      WHEN l_linenumber = 5 THEN CAST(l_partkey AS VARCHAR) || '.0' ELSE CAST(l_partkey AS VARCHAR) END AS product_id,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END
      AS total_weighted_landing_price
  FROM lines),
raw AS (
  SELECT * EXCLUDE (l_discount) FROM raw_once
  UNION ALL SELECT * EXCLUDE (l_discount) FROM raw_once WHERE l_discount > 0.095)"""

SPAN = """days_of_data AS (
  SELECT CAST(MIN(o_orderdate) AS DATE) AS first_day, CAST(MAX(o_orderdate) AS DATE) AS last_day FROM orders)"""
FIRST_DAY, LAST_DAY = "(SELECT first_day FROM days_of_data)", "(SELECT last_day FROM days_of_data)"
CUT_DAY = "(SELECT last_day - 29 FROM days_of_data)"

PANEL = LINES + ",\n" + SPAN + """,
panel AS (
  SELECT order_date AS date_, p_type AS product_id, r_name AS city_name, SUM(l_quantity) AS daily_quantity
  FROM lines GROUP BY 1, 2, 3)"""

EVENT_FIRST, EVENT_LAST = "(SELECT first_day FROM event_days)", "(SELECT last_day FROM event_days)"
EVENT_CUT = "(SELECT last_day - 5 FROM event_days)"

EVENT_PANEL = """event_days AS (
  SELECT CAST(MIN(ts) AS DATE) AS first_day, CAST(MAX(ts) AS DATE) AS last_day FROM events),
event_panel AS (
  SELECT CAST(ts AS DATE) AS date_, event_type AS product_id,
    CAST(CASE WHEN user_id < 50 THEN user_id % 2 WHEN user_id < 100 THEN 100 + user_id % 10
      ELSE 1000 + user_id END AS VARCHAR) AS city_name,
    SUM(value) AS daily_quantity
  FROM events GROUP BY 1, 2, 3)"""


def number(c: str) -> str:
    """Text to number; blank, junk, NaN and infinite values become NULL."""
    cast = f"TRY_CAST(NULLIF(TRIM({c}), '') AS DOUBLE)"
    return f"CASE WHEN isfinite({cast}) THEN {cast} END"


def day(c: str) -> str:
    formats = ["%Y-%m-%d", "%d-%m-%Y", "%Y/%m/%d", "%d/%m/%Y"]
    tries = ", ".join(f"TRY_STRPTIME(NULLIF(TRIM({c}), ''), '{f}')" for f in formats)
    return f"CAST(COALESCE({tries}) AS DATE)"


def grid(source: str, start: str, end: str, name: str = "grid") -> str:
    """Dense calendar over the series of ``source``."""
    return f"""{name} AS (
  SELECT CAST(d AS DATE) AS date_, s.product_id, s.city_name, COALESCE(r.daily_quantity, 0.0) AS daily_quantity
  FROM (SELECT DISTINCT product_id, city_name FROM {source}) s
  CROSS JOIN (SELECT UNNEST(generate_series({start}, {end}, INTERVAL 1 DAY)) AS d) t
  LEFT JOIN {source} r ON r.product_id = s.product_id AND r.city_name = s.city_name AND r.date_ = CAST(d AS DATE))"""
