"""Cleaning and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.catalog.views import ENRICHED, PRODUCTS, RAW, SALES, number
from stockloom.operators import cleaning as c
from stockloom.operators import profiling
from stockloom.schemas import SALES_COLUMNS

_COERCED = RAW + f""",
coerced AS (SELECT CAST(TRY_STRPTIME(NULLIF(TRIM(date_), ''), '%Y-%m-%d') AS DATE) AS date_, city_name, order_id, cart_id,
  dim_customer_key, {number('procured_quantity')} AS procured_quantity, {number('unit_selling_price')} AS unit_selling_price,
  {number('total_discount_amount')} AS total_discount_amount, TRY_CAST({number('product_id')} AS BIGINT) AS product_id,
  {number('total_weighted_landing_price')} AS total_weighted_landing_price FROM raw)"""
_COMPLETE = "date_ IS NOT NULL AND product_id IS NOT NULL AND procured_quantity IS NOT NULL AND unit_selling_price IS NOT NULL"


@query("cln01_clean_sales", f"WITH {_COERCED} SELECT DISTINCT {', '.join(SALES_COLUMNS)} FROM coerced WHERE {_COMPLETE}")
def _(t):
    return c.clean_sales(t.raw_sales)


@query(
    "cln01_counters",
    f"""WITH {_COERCED} SELECT COUNT(*) AS input_rows, COUNT(*) FILTER (NOT ({_COMPLETE})) AS removed_rows,
    (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(SALES_COLUMNS)} FROM coerced WHERE {_COMPLETE})) AS output_rows,
    COUNT(*) - COUNT(total_weighted_landing_price) AS missing_cost_rows FROM coerced""",
)
def _(t):
    return c.cleaning_counters(t.raw_sales)


_IMPUTED = _COERCED + f""",
based AS (SELECT * REPLACE (COALESCE(procured_quantity, 1.0) AS procured_quantity) FROM coerced
  WHERE date_ IS NOT NULL AND product_id IS NOT NULL AND COALESCE(procured_quantity, 1.0) > 0),
med AS (SELECT product_id, MEDIAN(unit_selling_price) AS m FROM based GROUP BY 1),
priced AS (SELECT b.* REPLACE (COALESCE(b.unit_selling_price, m, (SELECT MEDIAN(unit_selling_price) FROM based), 50.0) AS unit_selling_price),
  CASE WHEN b.unit_selling_price IS NOT NULL THEN 'original' WHEN m IS NOT NULL THEN 'product_median' ELSE 'overall_median' END AS price_source
  FROM based b LEFT JOIN med ON b.product_id = med.product_id),
imputed AS (SELECT *, COALESCE(total_weighted_landing_price, unit_selling_price * 0.75) AS recovered_landing_price,
  CASE WHEN total_weighted_landing_price IS NOT NULL THEN 'original' ELSE 'estimated_from_price' END AS cost_source
  FROM priced WHERE unit_selling_price >= 0)"""


def _imputed(t):
    return c.clean_and_impute(c.coerce_sales(t.raw_sales))


@query(
    "cln02_clean_and_impute",
    f"""WITH {_IMPUTED} SELECT product_id, city_name, price_source, cost_source, COUNT(*) AS row_count,
    SUM(procured_quantity) AS quantity, ROUND(SUM(unit_selling_price), 4) AS price_sum,
    ROUND(SUM(recovered_landing_price), 4) AS cost_sum FROM imputed GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return (
        _imputed(t)
        .groupBy("product_id", "city_name", "price_source", "cost_source")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("procured_quantity").alias("quantity"),
            F.round(F.sum("unit_selling_price"), 4).alias("price_sum"),
            F.round(F.sum("recovered_landing_price"), 4).alias("cost_sum"),
        )
    )


@query(
    "cln03_price_medians",
    f"""WITH {_COERCED}, med AS (SELECT product_id, MEDIAN(unit_selling_price) AS m FROM coerced GROUP BY 1)
    SELECT s.product_id, COALESCE(unit_selling_price, m, (SELECT MEDIAN(unit_selling_price) FROM coerced), 50.0) AS imputed_price,
    COUNT(*) AS row_count FROM coerced s LEFT JOIN med ON s.product_id = med.product_id
    WHERE unit_selling_price IS NULL GROUP BY 1, 2""",
)
def _(t):
    filled = c.impute_prices(c.coerce_sales(t.raw_sales)).where("price_source <> 'original'")
    return filled.groupBy("product_id", F.col("unit_selling_price").alias("imputed_price")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query(
    "cln04_cost_estimate",
    f"""WITH {SALES} SELECT product_id, CASE WHEN total_weighted_landing_price IS NOT NULL THEN 'original' ELSE 'estimated_from_price' END
    AS cost_source, COUNT(*) AS row_count, ROUND(SUM(procured_quantity * COALESCE(total_weighted_landing_price, unit_selling_price * 0.75)), 4) AS cost_sum
    FROM sales GROUP BY 1, 2""",
)
def _(t):
    rows = c.cost_estimate(t.sales).groupBy("product_id", "cost_source")
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum(F.col("procured_quantity") * F.col("recovered_landing_price")), 4).alias("cost_sum"),
    )


# Costs that vary by order, so that medians differ; some products have none at all.
_VARIED = SALES + """, varied AS (SELECT * REPLACE (CASE WHEN product_id % 37 = 0 OR (product_id % 5 = 0 AND city_name = 'ASIA') THEN NULL
  ELSE total_weighted_landing_price + order_id % 7 END AS total_weighted_landing_price) FROM sales)"""
_LOOKUP = _VARIED + """,
levels AS (SELECT product_id, city_name, GROUPING(city_name) AS level, QUANTILE_CONT(total_weighted_landing_price, 0.5) AS middle,
  COUNT(total_weighted_landing_price) AS known, COUNT(*) FILTER (total_weighted_landing_price IS NULL) AS blank
  FROM varied GROUP BY GROUPING SETS ((product_id, city_name), (product_id))),
lookup AS (SELECT near.product_id, near.city_name, near.blank AS missing_count, near.middle AS median_lp_prod_city,
  NULLIF(near.known, 0) AS valid_samples_prod_city, wide.middle AS median_lp_prod, NULLIF(wide.known, 0) AS valid_samples_prod,
  CASE WHEN near.known > 0 THEN 'Tier_1_Product_City_Median' WHEN wide.known > 0 THEN 'Tier_2_Product_Median'
    ELSE 'UNRESOLVED_NO_HISTORY' END AS recovery_tier, CASE WHEN near.known > 0 THEN near.middle ELSE wide.middle END AS recovered_landing_price
  FROM levels near JOIN levels wide ON near.level = 0 AND wide.level = 1 AND near.product_id = wide.product_id WHERE near.blank > 0)"""


def varied_costs(t):
    pid = F.col("product_id")
    gap = (pid % 37 == 0) | ((pid % 5 == 0) & (F.col("city_name") == "ASIA"))
    cost = F.when(~gap, F.col("total_weighted_landing_price") + F.col("order_id") % 7)
    return t.sales.withColumn("total_weighted_landing_price", cost)


@query("cln05_cost_recovery_lookup", f"WITH {_LOOKUP} SELECT * FROM lookup")
def _(t):
    return c.cost_recovery_lookup(varied_costs(t))


@query(
    "cln06_apply_cost_recovery",
    f"""WITH {_LOOKUP} SELECT v.product_id, v.city_name, CASE WHEN v.total_weighted_landing_price IS NOT NULL THEN 'original'
    ELSE COALESCE(recovery_tier, 'UNRESOLVED_NO_HISTORY') END AS price_fill_method, COUNT(*) AS row_count,
    ROUND(SUM(COALESCE(v.total_weighted_landing_price, recovered_landing_price)), 4) AS cost_sum
    FROM varied v LEFT JOIN lookup l ON v.product_id = l.product_id AND v.city_name = l.city_name GROUP BY 1, 2, 3""",
)
def _(t):
    sales = varied_costs(t)
    filled = c.apply_cost_recovery(sales, c.cost_recovery_lookup(sales))
    return filled.groupBy("product_id", "city_name", "price_fill_method").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("total_weighted_landing_price"), 4).alias("cost_sum"),
    )


@query(
    "cln07_recovery_summary",
    f"""WITH {_LOOKUP} SELECT recovery_tier, COUNT(DISTINCT product_id) AS unique_products, CAST(SUM(missing_count) AS BIGINT) AS missing_rows
    FROM lookup GROUP BY 1""",
)
def _(t):
    return c.recovery_summary(c.cost_recovery_lookup(varied_costs(t)))


@query(
    "cln07_unresolved_products",
    f"""WITH {_LOOKUP} SELECT product_id, CAST(SUM(missing_count) AS BIGINT) AS missing_count FROM lookup
    WHERE recovery_tier = 'UNRESOLVED_NO_HISTORY' GROUP BY 1""",
)
def _(t):
    return c.unresolved_products(c.cost_recovery_lookup(varied_costs(t)))


@query(
    "cln08_recover_attributes",
    f"""WITH {ENRICHED}, g AS (SELECT product_id, city_name, CASE WHEN order_id % 3 = 0 THEN ' ' WHEN order_id % 3 = 1 THEN NULL
      ELSE brand_name END AS brand FROM enriched)
    SELECT city_name, CASE WHEN NULLIF(TRIM(g.brand), '') IS NULL AND p.brand_name IS NOT NULL THEN p.brand_name ELSE g.brand END AS brand_name,
    NULLIF(TRIM(g.brand), '') IS NULL AND p.brand_name IS NOT NULL AS brand_name_filled, COUNT(*) AS row_count
    FROM g LEFT JOIN products p ON g.product_id = p.product_id GROUP BY 1, 2, 3""",
)
def _(t):
    order = F.col("order_id") % 3
    brand = F.when(order == 0, F.lit(" ")).when(order == 2, F.col("brand_name"))
    gappy = c.enrich(t.sales, t.products).withColumn("brand_name", brand)
    filled = c.recover_attributes(gappy.select("product_id", "city_name", "brand_name"), t.products, ["brand_name"])
    return filled.groupBy("city_name", "brand_name", "brand_name_filled").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "cln09_clean_products",
    """WITH raw AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq,
      CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'name ' || CAST(l_orderkey AS VARCHAR) END AS name, l_returnflag AS flag FROM lineitem),
    ok AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC, name DESC, flag DESC) AS rn FROM raw WHERE name <> '')
    SELECT CAST(id AS BIGINT) AS product_id, MAX(name) AS product_name, TRUE AS is_active FROM ok
    WHERE rn = 1 GROUP BY id""",
)
def _(t):
    lines = t.read("lineitem")
    raw = lines.select(
        F.concat(F.col("l_partkey").cast("string"), F.lit(".0")).alias("product_id"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit(" "))
        .otherwise(F.concat(F.lit(" name "), F.col("l_orderkey").cast("string")))
        .alias("product_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return c.clean_products(raw, "seq")


@query(
    "cln10_enrich",
    f"""WITH {ENRICHED} SELECT product_id, product_name, l0_category, COUNT(*) AS row_count, SUM(procured_quantity) AS quantity
    FROM enriched GROUP BY 1, 2, 3""",
)
def _(t):
    return (
        c.enrich(t.sales, t.products)
        .groupBy("product_id", "product_name", "l0_category")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("procured_quantity").alias("quantity"))
    )


@query(
    "cln11_unique_mapping",
    """WITH g AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN o_orderpriority
      ELSE 'C' || CAST(o_custkey % 10 AS VARCHAR) END AS tag FROM orders),
    m AS (SELECT o_custkey, MIN(tag) AS fill FROM g WHERE tag IS NOT NULL GROUP BY 1 HAVING MIN(tag) = MAX(tag))
    SELECT g.o_orderkey, g.o_custkey, COALESCE(tag, fill) AS tag, CASE WHEN tag IS NOT NULL THEN 'original'
      WHEN fill IS NOT NULL THEN 'unique_o_custkey' ELSE 'NOT_AVAILABLE' END AS fill_source
    FROM g LEFT JOIN m ON g.o_custkey = m.o_custkey""",
)
def _(t):
    tag = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).otherwise(
        F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string"))
    )
    orders = t.read("orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 != 0, tag).alias("tag")
    )
    return c.fill_by_unique_mapping(orders, "o_custkey", "tag")


@query(
    "cln12_brand_from_title",
    f"""WITH {PRODUCTS}, vocab AS (SELECT DISTINCT upper(p_type) AS term FROM part)
    SELECT product_id, product_name, (SELECT MAX(term) FROM vocab WHERE term = split_part(upper(product_name), ' ', 1)
      OR term = upper(product_name)) AS title_brand FROM products""",
)
def _(t):
    vocabulary = profiling.vocabulary(t.read("part"), "p_type")
    return c.brand_from_title(t.products.select("product_id", "product_name"), vocabulary)


_COSTS = """costs AS (SELECT product_id, city_name, MAX(CASE WHEN city_name <> 'EUROPE' THEN total_weighted_landing_price END) AS unit_cost
  FROM varied GROUP BY 1, 2)"""


def costs_of(t):
    # Costs of one region are blank, so its products take those of other cities.
    cost = F.when(F.col("city_name") != "EUROPE", F.col("total_weighted_landing_price"))
    return varied_costs(t).groupBy("product_id", "city_name").agg(F.max(cost).alias("unit_cost"))


@query(
    "cln13_unit_cost",
    f"""WITH {_VARIED}, {_COSTS}, known AS (SELECT * FROM costs WHERE unit_cost > 0),
    general AS (SELECT product_id, MIN_BY(unit_cost, city_name) AS unit_cost FROM known GROUP BY 1),
    series AS (SELECT DISTINCT product_id, city_name FROM varied)
    SELECT s.product_id, s.city_name, ROUND(COALESCE(k.unit_cost, g.unit_cost), 2) AS unit_cost FROM series s
    LEFT JOIN known k ON s.product_id = k.product_id AND s.city_name = k.city_name LEFT JOIN general g ON s.product_id = g.product_id""",
)
def _(t):
    return c.unit_cost(t.sales.select("product_id", "city_name").distinct(), costs_of(t))


@query(
    "cln14_product_label",
    f"""WITH {PRODUCTS} SELECT p_partkey AS product_id, CASE WHEN product_name IS NULL
      THEN 'Product name is unavailable; Product ID: ' || CAST(p_partkey AS VARCHAR)
      ELSE product_name || ' (Product ID: ' || CAST(p_partkey AS VARCHAR) || ')' END AS product_label
    FROM part LEFT JOIN products ON p_partkey = product_id""",
)
def _(t):
    return c.label_products(t.read("part").select(F.col("p_partkey").alias("product_id")), t.products)
