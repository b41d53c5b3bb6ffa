"""The delivered anomaly rule from z-score and forest, against plain Python over its written rows."""

import pandas as pd
import pytest

from stockloom.catalog import anomalies as catalog
from stockloom.catalog import load
from stockloom.session import materialize

KEY = ["date_", "product_id", "city_name"]


@pytest.fixture(scope="module")
def flagged(tables):
    return materialize(catalog.forest_flagged(tables)).toPandas()


def rule(r):
    """(type, severity) of one scored row, or None."""
    if not (abs(r.z_score) > 2.5 or r.is_isolation_anomaly):
        return None
    kind = "SPIKE_DEMAND" if r.residual > 0 or r.z_score > 2.5 else "DROP_STOCKOUT"
    z, actual, expected = abs(r.z_score), r.actual_demand, r.expected_demand
    both, gap = abs(r.z_score) > 2.5 and r.is_isolation_anomaly, abs(r.residual)
    if z >= 4 or (both and gap >= 100 and z >= 3) or (actual <= 10 and expected >= 150) or (r.residual >= 300 and z >= 3.5):
        severity = "CRITICAL"
    elif z >= 2.8 or (r.is_isolation_anomaly and gap >= 75) or (actual < 0.3 * expected and expected >= 100):
        severity = "MEDIUM"
    else:
        severity = "LOW"
    return kind, severity


@pytest.fixture(scope="module")
def wanted(flagged):
    rows = [(r.date_, r.product_id, r.city_name, *found) for r in flagged.itertuples() if (found := rule(r))]
    return pd.DataFrame(rows, columns=[*KEY, "anomaly_type", "severity"])


def same(df, columns, wanted):
    got = df.toPandas()[[*KEY, *columns]]
    assert sorted(map(tuple, got.values.tolist()), key=str) == sorted(map(tuple, wanted[[*KEY, *columns]].values.tolist()), key=str)


def test_every_alert_is_one_of_the_rule(spark, small, wanted, flagged):
    queries = load()
    assert len(wanted) > 0 and flagged.is_isolation_anomaly.any()
    same(queries["ano08_forest_classify"](spark, small), ["anomaly_type"], wanted)
    same(queries["ano09_forest_severity"](spark, small), ["severity"], wanted)
    same(queries["ano11_forest_export"](spark, small), ["anomaly_type", "severity"], wanted)


def test_rows_that_only_the_forest_finds_reach_the_alerts(spark, small, flagged, wanted):
    only = flagged[flagged.is_isolation_anomaly & (flagged.z_score.abs() <= 2.5)]
    assert len(only) > 0
    keys = set(map(tuple, only[KEY].values.tolist()))
    exported = load()["ano11_forest_export"](spark, small).toPandas()
    assert keys <= set(map(tuple, exported[KEY].values.tolist()))


def test_reports_count_the_same_alerts(spark, small, wanted):
    queries = load()
    stats = queries["ano12_forest_statistics"](spark, small).first()
    assert stats["total_anomalies"] == len(wanted)
    assert stats["spike_count"] == (wanted.anomaly_type == "SPIKE_DEMAND").sum()
    assert stats["critical_count"] == (wanted.severity == "CRITICAL").sum()
    summary = queries["ano15_forest_summary"](spark, small).first()
    assert (summary["total_anomalies"], summary["medium"]) == (len(wanted), (wanted.severity == "MEDIUM").sum())
    assert sum(r["row_count"] for r in queries["ano10_forest_recommend"](spark, small).collect()) == len(wanted)
    listed = queries["ano13_forest_list"](spark, small).toPandas()
    asia = wanted[(wanted.city_name.str.lower() == "asia") & (wanted.anomaly_type == "SPIKE_DEMAND")]
    assert len(listed) == min(20, len(asia)) and (listed.city_name.str.lower() == "asia").all()
    for name in ("ano14_forest_score", "ano16_forest_deviation"):
        assert queries[name](spark, small).count() == len(wanted)
