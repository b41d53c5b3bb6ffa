"""Market price queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.operators import market as m

_SKUS = """q AS (SELECT CASE WHEN l_partkey % 10 <> 0 THEN 'part ' || CAST(l_partkey AS VARCHAR) END AS commodity, ROUND(AVG(l_extendedprice / l_quantity), 2) AS price FROM lineitem GROUP BY 1),
div AS (SELECT p_partkey AS product_id, p_type AS category, 'PART ' || CAST(p_partkey AS VARCHAR) AS commodity, p_retailprice * (1 + (p_partkey % 4) * 0.4) AS baseline_price, p_size * 100 AS standard_holding_qty,
  COALESCE(price, p_retailprice * (1 + (p_partkey % 4) * 0.4) * CAST(1.1 AS DOUBLE)) AS live_market_price, CASE WHEN price IS NULL THEN 'baseline_estimate' ELSE 'quote' END AS price_source
  FROM part LEFT JOIN q ON 'part ' || CAST(p_partkey AS VARCHAR) = q.commodity),
d AS (SELECT *, round_even((live_market_price - baseline_price) / baseline_price * 100, 1) AS divergence_pct FROM div),
h AS (SELECT *, CASE WHEN divergence_pct >= 25 THEN 'TRIM_STOCK' WHEN divergence_pct >= 12 THEN 'MODERATE_REDUCTION' WHEN divergence_pct <= -10 THEN 'BULK_PROCURE' ELSE 'MAINTAIN_BASELINE' END AS action,
  CASE WHEN divergence_pct >= 25 THEN 'HIGH_INFLATION' WHEN divergence_pct >= 12 THEN 'MODERATE_SURGE' WHEN divergence_pct <= -10 THEN 'OPPORTUNITY_DIP' ELSE 'STABLE_MARKET' END AS risk_level,
  CAST(round_even(standard_holding_qty * CAST(CASE WHEN divergence_pct >= 25 THEN 0.8 WHEN divergence_pct >= 12 THEN 0.9 WHEN divergence_pct <= -10 THEN 1.25 ELSE 1.0 END AS DOUBLE), 0) AS BIGINT) AS recommended_holding_qty FROM d)"""


def _divergence(t):
    part = F.col("p_partkey")
    skus = t.read("part").select(
        part.alias("product_id"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("PART "), part.cast("string")).alias("commodity"),
        (F.col("p_retailprice") * (1 + (part % 4) * 0.4)).alias("baseline_price"),
        (F.col("p_size") * 100).alias("standard_holding_qty"),
    )
    # Quotes of every tenth part have lost their name, so their baseline is the estimate.
    name = F.when(F.col("l_partkey") % 10 != 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    quotes = (
        t.read("lineitem")
        .groupBy(name.alias("commodity"))
        .agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 2).alias("price"))
    )
    return m.price_divergence(skus, quotes)


@query(
    "mkt01_price_divergence",
    f"""WITH {_SKUS} SELECT product_id, commodity, ROUND(baseline_price, 4) AS baseline_price, ROUND(live_market_price, 4) AS live_market_price, price_source, divergence_pct FROM d""",
)
def _(t):
    rows = _divergence(t).withColumns({c: F.round(c, 4) for c in ["baseline_price", "live_market_price"]})
    return rows.select("product_id", "commodity", "baseline_price", "live_market_price", "price_source", "divergence_pct")


@query(
    "mkt02_holding_decision",
    f"""WITH {_SKUS} SELECT product_id, divergence_pct, action, risk_level, recommended_holding_qty, recommended_holding_qty - standard_holding_qty AS quantity_delta FROM h""",
)
def _(t):
    rows = m.holding_decision(_divergence(t))
    return rows.select("product_id", "divergence_pct", "action", "risk_level", "recommended_holding_qty", "quantity_delta")


@query(
    "mkt03_market_kpis",
    f"""WITH {_SKUS} SELECT COUNT(*) AS evaluated, COUNT(*) FILTER (divergence_pct >= 15) AS surges, COUNT(*) FILTER (divergence_pct <= -10) AS dips,
    COUNT(*) FILTER (divergence_pct < 15 AND divergence_pct > -10) AS stable FROM d WHERE lower(category) = 'economy'""",
)
def _(t):
    return m.market_kpis(m.holding_decision(_divergence(t)), "Economy")


_HREF, _TEXT = r'<a href="([^"]*)"', r'<a href="[^"]*">([^<]*)</a>'


@query(
    "mkt04_extract_quotes",
    f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS n, regexp_extract_all(html, '{_TEXT}', 1) AS p, regexp_extract(html, '<title>([^<]+)<', 1) AS ti FROM pages),
    y AS (SELECT page_id, ti, n, p, UNNEST(generate_series(1, least(len(n), len(p)))) AS i FROM x),
    z AS (SELECT page_id, ti, trim(n[i]) AS commodity, p[i] AS price_text, i FROM y)
    SELECT page_id, commodity, MIN_BY(price_text, i) AS price_text, TRY_CAST(MIN_BY(price_text, i) AS DOUBLE) AS price_inr_per_kg, 'Grains & Essentials' AS category, '₹ / Kg' AS unit,
    NULLIF(trim(MAX(ti)), '') AS as_on_date FROM z GROUP BY 1, 2""",
)
def _(t):
    return m.extract_quotes(t.read("pages"), name_pattern=_HREF, price_pattern=_TEXT, date_pattern="<title>([^<]+)<")
