"""Anomaly queries: the z-score path has a SQL twin, the forest does not."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.forecasts import RESULTS, baselines
from stockloom.catalog.registry import query
from stockloom.operators import anomalies as an
from stockloom.operators import isolation
from stockloom.schemas import GRAIN
from stockloom.session import materialize

BASE = RESULTS + """,
history AS (SELECT date_, product_id, city_name, daily_quantity AS actual_demand, AVG(daily_quantity) OVER w AS rolling_mean_14,
  COALESCE(STDDEV_SAMP(daily_quantity) OVER w, 0.0) AS rolling_std_14, COUNT(daily_quantity) OVER w AS history_count FROM panel
  WINDOW w AS (PARTITION BY product_id, city_name ORDER BY date_ ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
joined AS (SELECT f.date_, f.product_id, f.city_name, f.pred_ma_7 AS expected_demand, h.actual_demand, rolling_mean_14, rolling_std_14, history_count
  FROM results f JOIN history h USING (date_, product_id, city_name)),
feat AS (SELECT *, actual_demand - expected_demand AS residual, CASE WHEN expected_demand > 0 THEN (actual_demand - expected_demand) / expected_demand
    WHEN actual_demand > 0 THEN 1.0 ELSE 0.0 END AS relative_residual FROM joined),
z AS (SELECT *, round_even(CASE WHEN history_count >= 7 AND rolling_std_14 > 1e-6 THEN (actual_demand - rolling_mean_14) / rolling_std_14
    WHEN history_count >= 7 THEN sign(actual_demand - rolling_mean_14) * least(abs(actual_demand - rolling_mean_14) / (rolling_mean_14 + 1.0), 5.0) ELSE 0.0 END, 4) AS z_score FROM feat),
flagged AS (SELECT *, abs(z_score) > 1.2 AS is_zscore_anomaly, abs(z_score) AS anomaly_score FROM z),
typed AS (SELECT *, CASE WHEN residual > 0 OR z_score > 1.2 THEN 'SPIKE_DEMAND' ELSE 'DROP_STOCKOUT' END AS anomaly_type FROM flagged WHERE is_zscore_anomaly),
alerts AS (SELECT date_, product_id, city_name, round_even(actual_demand, 2) AS actual_demand, round_even(expected_demand, 2) AS expected_demand, anomaly_score, anomaly_type,
  CASE WHEN abs(z_score) >= 4 OR (actual_demand <= 10 AND expected_demand >= 150) OR (residual >= 300 AND abs(z_score) >= 3.5) THEN 'CRITICAL'
    WHEN abs(z_score) >= 2.8 OR (actual_demand < 0.3 * expected_demand AND expected_demand >= 100) THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE anomaly_type WHEN 'SPIKE_DEMAND' THEN 'Review inventory availability and prepare replenishment.'
    ELSE 'Check inventory, stock availability, and delivery/supply status.' END AS action_recommendation FROM typed)"""
# A low threshold, so that the sparse panel has alerts of every kind.
THRESHOLD = 1.2


def _joined(t):
    results = baselines(t)
    return an.join_baseline(results, an.baseline(t.panel), "pred_ma_7")


def _flagged(t):
    return an.zscore(an.residual_features(_joined(t)), THRESHOLD)


def _typed(t):
    rows = _flagged(t).withColumns(
        {
            "is_isolation_anomaly": F.lit(False),
            "anomaly_score": F.abs("z_score"),
        }
    )
    return an.classify(rows, THRESHOLD)


def alerts(t):
    return an.export_anomalies(an.recommend(an.severity(_typed(t))))


@query("ano01_expected_column", f"WITH {RESULTS} SELECT 'pred_prophet' AS expected_column, COUNT(*) AS row_count FROM results")
def _(t):
    rows = baselines(t)
    return rows.agg(F.lit(an.pick_expected(rows)).alias("expected_column"), F.count(F.lit(1)).alias("row_count"))


@query(
    "ano02_baseline",
    f"""WITH {BASE} SELECT date_, product_id, city_name, actual_demand, ROUND(rolling_mean_14, 6) AS rolling_mean_14, ROUND(rolling_std_14, 6) AS rolling_std_14, history_count FROM history""",
)
def _(t):
    return an.baseline(t.panel).withColumns({c: F.round(c, 6) for c in ["rolling_mean_14", "rolling_std_14"]})


@query(
    "ano03_join_baseline",
    f"""WITH {BASE} SELECT date_, product_id, city_name, ROUND(expected_demand, 6) AS expected_demand, actual_demand, ROUND(rolling_mean_14, 6) AS rolling_mean_14,
    ROUND(rolling_std_14, 6) AS rolling_std_14, history_count FROM joined""",
)
def _(t):
    return _joined(t).withColumns({c: F.round(c, 6) for c in ["expected_demand", "rolling_mean_14", "rolling_std_14"]})


@query(
    "ano04_match_stats",
    f"""WITH {BASE} SELECT (SELECT COUNT(*) FROM joined) AS matched, (SELECT COUNT(*) FROM results) - (SELECT COUNT(*) FROM joined) AS unmatched_forecast,
    (SELECT COUNT(*) FROM history) - (SELECT COUNT(*) FROM joined) AS unmatched_demand""",
)
def _(t):
    return an.match_stats(baselines(t), t.panel)


@query(
    "ano05_residual_features",
    f"""WITH {BASE} SELECT date_, product_id, city_name, ROUND(residual, 6) AS residual, ROUND(relative_residual, 6) AS relative_residual,
    ROUND(rolling_std_14, 6) AS rolling_volatility, actual_demand AS sales_volume FROM feat""",
)
def _(t):
    rows = an.residual_features(_joined(t))
    return rows.select(
        *GRAIN, *[F.round(c, 6).alias(c) for c in ["residual", "relative_residual", "rolling_volatility"]], "sales_volume"
    )


@query("ano06_zscore", f"WITH {BASE} SELECT date_, product_id, city_name, z_score, is_zscore_anomaly FROM flagged")
def _(t):
    return _flagged(t).select(*GRAIN, "z_score", "is_zscore_anomaly")


@query("ano07_isolation_forest")
def _(t):
    rows = an.residual_features(_joined(t))
    return isolation.isolation_forest(rows, ["residual", "rolling_volatility", "sales_volume"], GRAIN).select(
        *GRAIN, "is_isolation_anomaly", "anomaly_score"
    )


# The delivered rule: z-score above 2.5 or forest, then both severity rules.  SQL cannot
# repeat the forest, so these queries are checked against their written rows instead.
FOREST_THRESHOLD = 2.5


def forest_flagged(t):
    rows = an.zscore(an.residual_features(_joined(t)), FOREST_THRESHOLD)
    return isolation.isolation_forest(rows, ["residual", "rolling_volatility", "sales_volume"], GRAIN)


def forest_typed(t):
    return an.classify(forest_flagged(t), FOREST_THRESHOLD)


def forest_alerts(t):
    return an.export_anomalies(an.recommend(an.severity(forest_typed(t))))


@query("ano08_forest_chain")
def _(t):
    return forest_alerts(t)


@query("ano08_forest_classify")
def _(t):
    return forest_typed(t).select(*GRAIN, "z_score", "is_isolation_anomaly", "anomaly_type")


@query("ano09_forest_severity")
def _(t):
    return an.severity(forest_typed(t)).select(*GRAIN, "severity")


@query("ano10_forest_recommend")
def _(t):
    rows = an.recommend(an.severity(forest_typed(t))).groupBy("anomaly_type", "action_recommendation")
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


@query("ano11_forest_export")
def _(t):
    return materialize(forest_alerts(t))


@query("ano12_forest_statistics")
def _(t):
    return an.anomaly_stats(forest_alerts(t))


@query("ano13_forest_list")
def _(t):
    return an.list_alerts(forest_alerts(t), "ALL", city="Asia", anomaly_type="spike_demand", limit=20)


@query("ano14_forest_score")
def _(t):
    return an.alert_score(forest_alerts(t)).select(*GRAIN, "alert_score")


@query("ano15_forest_summary")
def _(t):
    return an.alert_summary(forest_alerts(t))


@query("ano16_forest_deviation")
def _(t):
    return an.deviation(forest_alerts(t)).select(*GRAIN, "deviation", "deviation_pct")


@query(
    "ano08_forest_check",
    f"""WITH {BASE} SELECT COUNT(*) AS rows_scored, COUNT(*) FILTER (abs(z_score) > 2.5) AS zscore_alerts,
    TRUE AS forest_share_is_small, TRUE AS scores_in_range FROM z""",
)
def _(t):
    return forest_flagged(t).agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.count_if("is_zscore_anomaly").alias("zscore_alerts"),
        (F.count_if("is_isolation_anomaly") <= 0.03 * F.count(F.lit(1)) + 1).alias("forest_share_is_small"),
        (F.min("anomaly_score").between(0, 1) & F.max("anomaly_score").between(0, 1)).alias("scores_in_range"),
    )


@query("ano08_classify", f"WITH {BASE} SELECT date_, product_id, city_name, z_score, anomaly_type FROM typed")
def _(t):
    return _typed(t).select(*GRAIN, "z_score", "anomaly_type")


@query("ano09_severity", f"WITH {BASE} SELECT date_, product_id, city_name, severity FROM alerts")
def _(t):
    return an.severity(_typed(t)).select(*GRAIN, "severity")


@query("ano10_recommend", f"WITH {BASE} SELECT anomaly_type, action_recommendation, COUNT(*) AS row_count FROM alerts GROUP BY 1, 2")
def _(t):
    rows = an.recommend(an.severity(_typed(t))).groupBy("anomaly_type", "action_recommendation")
    return rows.agg(F.count(F.lit(1)).alias("row_count"))


@query("ano11_export", f"WITH {BASE} SELECT * FROM alerts")
def _(t):
    return alerts(t)


@query(
    "ano12_run_statistics",
    f"""WITH {BASE} SELECT COUNT(*) AS total_anomalies, COUNT(*) FILTER (anomaly_type = 'SPIKE_DEMAND') AS spike_count, COUNT(*) FILTER (anomaly_type = 'DROP_STOCKOUT') AS drop_count,
    COUNT(*) FILTER (anomaly_type = 'PRICE_ANOMALY') AS price_count, COUNT(*) FILTER (severity = 'CRITICAL') AS critical_count,
    COUNT(*) FILTER (severity = 'MEDIUM') AS medium_count, COUNT(*) FILTER (severity = 'LOW') AS low_count FROM alerts""",
)
def _(t):
    return an.anomaly_stats(alerts(t))


@query(
    "ano13_list_alerts",
    f"""WITH {BASE} SELECT * FROM alerts WHERE lower(city_name) = 'asia' AND anomaly_type = 'SPIKE_DEMAND'
    ORDER BY date_ DESC, anomaly_score DESC, product_id, city_name LIMIT 20""",
)
def _(t):
    return an.list_alerts(alerts(t), "ALL", city="Asia", anomaly_type="spike_demand", limit=20)


@query(
    "ano14_alert_score",
    f"""WITH {BASE} SELECT date_, product_id, city_name, round_even(abs(actual_demand - expected_demand) / greatest(1.0, expected_demand), 4) AS alert_score FROM alerts""",
)
def _(t):
    return an.alert_score(alerts(t)).select(*GRAIN, "alert_score")


@query(
    "ano15_alert_summary",
    f"""WITH {BASE} SELECT COUNT(*) AS total_anomalies, COUNT(*) FILTER (severity = 'CRITICAL') AS critical, COUNT(*) FILTER (severity = 'MEDIUM') AS medium,
    COUNT(*) FILTER (severity = 'LOW') AS low, COUNT(*) FILTER (anomaly_type LIKE '%SPIKE%') AS spike_demand, COUNT(*) FILTER (anomaly_type LIKE '%DROP%') AS drop_stockout,
    COUNT(*) FILTER (anomaly_type LIKE '%PRICE%') AS price_anomaly, MIN(date_) AS earliest_date, MAX(date_) AS latest_date FROM alerts""",
)
def _(t):
    return an.alert_summary(alerts(t))


@query(
    "ano16_deviation",
    f"""WITH {BASE} SELECT date_, product_id, city_name, round_even(actual_demand - expected_demand, 1) AS deviation,
    CASE WHEN expected_demand <> 0 THEN round_even((actual_demand - expected_demand) / expected_demand * 100, 1) ELSE 0.0 END AS deviation_pct FROM alerts""",
)
def _(t):
    return an.deviation(alerts(t)).select(*GRAIN, "deviation", "deviation_pct")
