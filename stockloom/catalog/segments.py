"""Segmentation and volatility queries (AGG-20 .. AGG-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.catalog.views import FIRST_DAY, LAST_DAY, SALES, SPAN
from stockloom.operators import segments as s

_FIXED = SPAN + f""",
days AS (SELECT product_id, date_, SUM(procured_quantity) AS q FROM sales GROUP BY 1, 2),
full_ AS (SELECT p.product_id, COALESCE(q, 0.0) AS q FROM (SELECT DISTINCT product_id FROM days) p
  CROSS JOIN (SELECT UNNEST(generate_series({FIRST_DAY}, {LAST_DAY}, INTERVAL 1 DAY)) AS d) t
  LEFT JOIN days ON days.product_id = p.product_id AND days.date_ = CAST(d AS DATE)),
stats AS (SELECT product_id, SUM(q) AS total_demand, AVG(q) AS avg_daily_demand, STDDEV_SAMP(q) AS std_daily_demand,
  CASE WHEN AVG(q) > 0 THEN STDDEV_SAMP(q) / AVG(q) ELSE 0.0 END AS cv, COUNT(*) FILTER (q > 0) AS active_days,
  CAST(COUNT(*) FILTER (q = 0) AS BIGINT) AS zero_days, COUNT(*) FILTER (q > 0) / COUNT(*) AS demand_day_ratio FROM full_ GROUP BY 1)"""

_SPAN = """days AS (SELECT product_id, date_, SUM(procured_quantity) AS q FROM sales GROUP BY 1, 2),
span AS (SELECT product_id, MIN(date_) AS lo, MAX(date_) AS hi FROM days GROUP BY 1),
full_ AS (SELECT p.product_id, COALESCE(q, 0.0) AS q FROM (SELECT product_id, UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM span) p
  LEFT JOIN days ON days.product_id = p.product_id AND days.date_ = CAST(d AS DATE)),
own AS (SELECT product_id, SUM(q) AS total_demand, AVG(q) AS avg_daily_demand, STDDEV_SAMP(q) AS std_daily_demand,
  CASE WHEN AVG(q) > 0 THEN STDDEV_SAMP(q) / AVG(q) ELSE 0.0 END AS cv, COUNT(*) FILTER (q > 0) AS active_demand_days,
  COUNT(*) FILTER (q = 0) AS zero_demand_days FROM full_ GROUP BY 1)"""

_SEGMENTS = _FIXED + """,
q AS (SELECT QUANTILE_CONT(avg_daily_demand, 0.5) AS p50, QUANTILE_CONT(avg_daily_demand, 0.75) AS p75 FROM stats),
classed AS (SELECT *, CASE WHEN avg_daily_demand >= (SELECT p75 FROM q) THEN 'High' WHEN avg_daily_demand >= (SELECT p50 FROM q) THEN 'Medium' ELSE 'Low' END AS demand_volume,
  CASE WHEN cv < 0.5 THEN 'Stable' WHEN cv < 1.0 THEN 'Moderate' ELSE 'Volatile' END AS volatility,
  CASE WHEN demand_day_ratio < 0.25 THEN 'Highly Intermittent' WHEN demand_day_ratio < 0.5 THEN 'Intermittent' ELSE 'Regular' END AS demand_pattern,
  SUM(total_demand) OVER (ORDER BY total_demand DESC, product_id ROWS UNBOUNDED PRECEDING) / (SELECT SUM(total_demand) FROM stats) * 100 AS cum FROM stats),
abc AS (SELECT *, CASE WHEN ROUND(cum, 9) <= 80 THEN 'A' WHEN ROUND(cum, 9) <= 95 THEN 'B' ELSE 'C' END AS abc_class FROM classed),
segments AS (SELECT *, abc_class || ' | ' || demand_volume || ' | ' || volatility || ' | ' || demand_pattern AS segment FROM abc)"""

_STATS_OUT = "product_id, total_demand, ROUND(avg_daily_demand, 6) AS avg_daily_demand, ROUND(std_daily_demand, 6) AS std_daily_demand, ROUND(cv, 6) AS cv"


def _rounded(*columns):
    return {c: F.round(c, 6) for c in ["avg_daily_demand", "std_daily_demand", "cv", *columns]}


def _stats(t):
    return s.product_stats(t.sales, t.days.first, t.days.last)


@query(
    "agg20_product_stats",
    f"""WITH {SALES}, {_FIXED} SELECT {_STATS_OUT}, active_days, CAST(zero_days AS BIGINT) AS zero_days,
    ROUND(demand_day_ratio, 6) AS demand_day_ratio FROM stats""",
)
def _(t):
    return _stats(t).withColumns(_rounded("demand_day_ratio"))


@query("agg21_own_span_stats", f"WITH {SALES}, {_SPAN} SELECT {_STATS_OUT}, active_demand_days, zero_demand_days FROM own")
def _(t):
    return s.product_stats_own_span(t.sales).withColumns(_rounded())


@query("agg22_volume_class", f"WITH {SALES}, {_SEGMENTS} SELECT product_id, demand_volume FROM segments")
def _(t):
    return s.volume_class(_stats(t)).select("product_id", "demand_volume")


@query("agg23_volatility_class", f"WITH {SALES}, {_SEGMENTS} SELECT product_id, volatility FROM segments")
def _(t):
    return s.volatility_class(_stats(t)).select("product_id", "volatility")


@query("agg24_pattern_class", f"WITH {SALES}, {_SEGMENTS} SELECT product_id, demand_pattern FROM segments")
def _(t):
    return s.pattern_class(_stats(t)).select("product_id", "demand_pattern")


@query("agg25_segments", f"WITH {SALES}, {_SEGMENTS} SELECT product_id, segment, total_demand FROM segments")
def _(t):
    return s.segment(_stats(t)).select("product_id", "segment", "total_demand")


@query(
    "agg25_segment_summary",
    f"""WITH {SALES}, {_SEGMENTS} SELECT segment, COUNT(*) AS products, SUM(total_demand) AS total_demand,
    ROUND(AVG(avg_daily_demand), 6) AS avg_daily_demand FROM segments GROUP BY 1""",
)
def _(t):
    return s.segment_summary(s.segment(_stats(t)))


@query(
    "agg25_combination_counts",
    f"""WITH {SALES}, {_SEGMENTS} SELECT abc_class, demand_volume, volatility, demand_pattern, COUNT(*) AS products
    FROM segments GROUP BY 1, 2, 3, 4""",
)
def _(t):
    return s.class_counts(s.segment(_stats(t)), ["abc_class", "demand_volume", "volatility", "demand_pattern"])


@query(
    "agg26_high_priority",
    f"""WITH {SALES}, {_SEGMENTS} SELECT product_id, total_demand, active_days, abc_class, demand_volume, volatility, demand_pattern FROM segments
    WHERE abc_class = 'A' AND demand_volume = 'High' AND volatility IN ('Moderate', 'Volatile') ORDER BY total_demand DESC, product_id LIMIT 20""",
)
def _(t):
    return s.high_priority(s.segment(_stats(t))).select(
        "product_id", "total_demand", "active_days", "abc_class", "demand_volume", "volatility", "demand_pattern"
    )


@query(
    "agg26_slow_movers",
    f"""WITH {SALES}, {_SEGMENTS} SELECT COUNT(*) FILTER (demand_pattern <> 'Regular') AS slow_products, COUNT(*) AS products,
    ROUND(COUNT(*) FILTER (demand_pattern <> 'Regular') / COUNT(*) * 100, 2) AS slow_share_pct FROM segments""",
)
def _(t):
    return s.slow_mover_share(s.pattern_class(_stats(t)))


@query(
    "agg26_slow_mover_list",
    f"WITH {SALES}, {_SEGMENTS} SELECT product_id, active_days, demand_pattern FROM segments WHERE demand_pattern <> 'Regular'",
)
def _(t):
    return s.slow_movers(s.pattern_class(_stats(t))).select("product_id", "active_days", "demand_pattern")


@query(
    "agg27_volatility_report",
    f"""WITH {SALES}, {_SPAN} SELECT CASE WHEN cv < 0.5 THEN 'Low' WHEN cv < 1.0 THEN 'Medium' ELSE 'High' END AS volatility_class, COUNT(*) AS products,
    ROUND(AVG(avg_daily_demand), 6) AS avg_demand, ROUND(AVG(cv), 6) AS avg_cv FROM own GROUP BY 1""",
)
def _(t):
    return s.volatility_report(s.product_stats_own_span(t.sales))


@query(
    "agg27_most_volatile",
    f"WITH {SALES}, {_SPAN} SELECT product_id, ROUND(cv, 6) AS cv FROM own ORDER BY own.cv DESC, product_id LIMIT 20",
)
def _(t):
    return s.top_by(s.product_stats_own_span(t.sales), "cv").select("product_id", F.round("cv", 6).alias("cv"))


@query(
    "agg27_zero_day_counts",
    f"""WITH {SALES}, {_SPAN} SELECT COUNT(*) FILTER (zero_demand_days > 0) AS with_zero_day,
    COUNT(*) FILTER (zero_demand_days / (zero_demand_days + active_demand_days) > 0.5) AS mostly_zero FROM own""",
)
def _(t):
    return s.zero_day_counts(s.product_stats_own_span(t.sales))


@query(
    "agg27_busy_and_volatile",
    f"""WITH {SALES}, {_SPAN} SELECT product_id, ROUND(avg_daily_demand, 6) AS avg_daily_demand, ROUND(cv, 6) AS cv FROM own
    WHERE avg_daily_demand >= (SELECT QUANTILE_CONT(avg_daily_demand, 0.75) FROM own) AND cv >= (SELECT QUANTILE_CONT(cv, 0.75) FROM own)""",
)
def _(t):
    rows = s.busy_and_volatile(s.product_stats_own_span(t.sales))
    return rows.select("product_id", F.round("avg_daily_demand", 6).alias("avg_daily_demand"), F.round("cv", 6).alias("cv"))
