"""Boundary values of every rule table."""

import pytest
from pyspark.sql import functions as F

from stockloom.operators import anomalies as an
from stockloom.operators import audits, external, inventory, market, messages, profiling, segments, validation
from stockloom.operators.demand import abc_class
from stockloom.operators.forecasting import model_family, sbc_classify


def column(df, name):
    return [r[name] for r in df.collect()]


def test_cover_bands(spark):
    df = spark.createDataFrame([(2.0,), (2.1,), (4.0,), (4.1,), (15.0,), (15.1,)], "days_of_cover double")
    rows = inventory.cover_risk(df).collect()
    assert [r["stockout_risk"] for r in rows] == [
        "CRITICAL_STOCKOUT", "REORDER_RECOMMENDED", "REORDER_RECOMMENDED", "OPTIMAL", "OPTIMAL", "OVERSTOCK",
    ]
    assert [r["reorder_urgency"] for r in rows] == ["HIGH", "MEDIUM", "MEDIUM", "NONE", "NONE", "LOW"]


def test_policy_rounds_up_but_not_float_noise(spark):
    df = spark.createDataFrame(
        [("p", "c", 0.1, 0.0, 5), ("p", "d", 10.0, 4.0, 5)],
        "product_id string, city_name string, mean_daily_demand double, std_daily_demand double, active_days_in_window long",
    )
    rows = {r["city_name"]: r for r in inventory.inventory_policy(df, lead_time=30).collect()}
    # 0.1 * 30 is 3.0000000000000004 in floating point and must stay 3.
    assert rows["c"]["reorder_point"] == 3 and rows["c"]["safety_stock"] == 0
    normal = {r["city_name"]: r for r in inventory.inventory_policy(df).collect()}["d"]
    assert (normal["safety_stock"], normal["reorder_point"], normal["target_stock_level"]) == (12, 42, 112)
    other = inventory.recompute(df, 3, 0.85).where("city_name = 'd'").first()
    assert other["safety_stock"] == 12  # unknown service levels use the 95 % factor


@pytest.mark.parametrize(
    "stock, risk, order",
    [(11.9, "CRITICAL_STOCKOUT", 100.1), (12.0, "REORDER_RECOMMENDED", 100.0), (42.0, "REORDER_RECOMMENDED", 70.0),
     (42.1, "OPTIMAL", 0.0), (156.7, "OPTIMAL", 0.0), (156.9, "OVERSTOCK", 0.0)],
)
def test_order_rules(spark, stock, risk, order):
    policy = inventory.inventory_policy(
        spark.createDataFrame(
            [("p", "d", 10.0, 4.0, 5)],
            "product_id string, city_name string, mean_daily_demand double, std_daily_demand double, active_days_in_window long",
        )
    )
    held = spark.createDataFrame([("p", "d", stock)], "product_id string, city_name string, current_stock double")
    row = inventory.recommend_orders(policy, held).first()
    assert (row["risk_status"], row["recommended_order_qty"]) == (risk, order)


def test_holding_rules(spark):
    edges = [25.0, 24.9, 12.0, 11.9, -9.9, -10.0]
    df = spark.createDataFrame([(d, 1000) for d in edges], "divergence_pct double, standard_holding_qty int")
    rows = market.holding_decision(df).collect()
    assert [r["action"] for r in rows] == [
        "TRIM_STOCK", "MODERATE_REDUCTION", "MODERATE_REDUCTION", "MAINTAIN_BASELINE", "MAINTAIN_BASELINE", "BULK_PROCURE",
    ]
    assert [r["recommended_holding_qty"] for r in rows] == [800, 900, 900, 1000, 1000, 1250]
    assert [r["quantity_delta"] for r in rows] == [-200, -100, -100, 0, 0, 250]


def test_missing_quote_uses_baseline_plus_ten_percent(spark):
    skus = spark.createDataFrame([("1", "Rice", 40.0), ("2", "Gold", 50.0)], "product_id string, commodity string, baseline_price double")
    quotes = spark.createDataFrame([("RICE", 50.0)], "commodity string, price double")
    rows = {r["product_id"]: r for r in market.price_divergence(skus, quotes).collect()}
    assert (rows["1"]["divergence_pct"], rows["1"]["price_source"]) == (25.0, "quote")
    assert (rows["2"]["divergence_pct"], rows["2"]["price_source"]) == (10.0, "baseline_estimate")


def test_quotes_pair_by_position_and_first_counts(spark):
    html = (
        '<span id="lblDate1">01/07/2022</span><i class="lblCommName">Rice</i><i class="lblCommName">Onion </i>'
        '<i class="lblCommName">Rice</i><i class="lblCommName">Salt</i>'
        '<b class="lblPrices">40.5</b><b class="lblPrices">30</b><b class="lblPrices">99</b>'
    )
    pages = spark.createDataFrame([(1, html), (2, "<p>nothing</p>")], "page_id int, html string")
    rows = {r["commodity"]: r for r in market.extract_quotes(pages).collect()}
    assert {k: r["price_inr_per_kg"] for k, r in rows.items()} == {"Rice": 40.5, "Onion": 30.0}
    assert rows["Onion"]["category"] == "Vegetables" and rows["Rice"]["as_on_date"] == "01/07/2022"


def test_abc_limits(spark):
    df = spark.createDataFrame([(80.0,), (80.01,), (95.0,), (95.01,)], "c double")
    assert column(df.select(abc_class(F.col("c")).alias("a")), "a") == ["A", "B", "B", "C"]


def test_volatility_and_pattern_limits(spark):
    df = spark.createDataFrame([(0.49, 0.24), (0.5, 0.25), (0.99, 0.49), (1.0, 0.5)], "cv double, demand_day_ratio double")
    assert column(segments.volatility_class(df), "volatility") == ["Stable", "Moderate", "Moderate", "Volatile"]
    assert column(segments.pattern_class(df), "demand_pattern") == [
        "Highly Intermittent", "Intermittent", "Intermittent", "Regular",
    ]


def test_inventory_volatility_limits(spark):
    rows = [(100.0, 36.0, 1), (100.0, 35.0, 1), (100.0, 20.0, 1), (100.0, 1.0, 20001), (100.0, 1.0, 10001), (0.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "mean_daily_demand double, std_daily_demand double, reorder_point long")
    assert column(inventory.volatility_status(df), "status") == [
        "HIGH_VOLATILITY", "ATTENTION_NEEDED", "SAFE", "HIGH_VOLATILITY", "ATTENTION_NEEDED", "SAFE",
    ]


SEVERITY = [
    # z, residual, actual, expected, z flagged, forest flagged, severity
    (4.0, 1.0, 50.0, 49.0, True, False, "CRITICAL"),
    (-4.0, -1.0, 50.0, 51.0, True, False, "CRITICAL"),
    (3.0, 100.0, 200.0, 100.0, True, True, "CRITICAL"),
    (3.0, 100.0, 200.0, 100.0, True, False, "MEDIUM"),
    (0.0, -140.0, 10.0, 150.0, False, True, "CRITICAL"),
    (0.0, -139.0, 11.0, 150.0, False, True, "MEDIUM"),
    (3.5, 300.0, 400.0, 100.0, True, False, "CRITICAL"),
    (3.4, 300.0, 400.0, 100.0, True, False, "MEDIUM"),
    (2.8, 1.0, 50.0, 49.0, True, False, "MEDIUM"),
    (2.7, 1.0, 50.0, 49.0, True, False, "LOW"),
    (0.0, 75.0, 175.0, 100.0, False, True, "MEDIUM"),
    (0.0, 74.0, 174.0, 100.0, False, True, "LOW"),
    (0.0, -70.1, 29.9, 100.0, False, True, "MEDIUM"),
    (0.0, -70.0, 30.0, 100.0, False, True, "LOW"),
]


@pytest.mark.parametrize("z, residual, actual, expected, zf, iso, wanted", SEVERITY)
def test_severity(spark, z, residual, actual, expected, zf, iso, wanted):
    df = spark.createDataFrame(
        [(z, residual, actual, expected, zf, iso)],
        "z_score double, residual double, actual_demand double, expected_demand double, is_zscore_anomaly boolean, is_isolation_anomaly boolean",
    )
    assert an.severity(df).first()["severity"] == wanted


def test_zscore_rules(spark):
    rows = [
        (10.0, 5.0, 2.0, 6, 0.0),  # too little history
        (10.0, 5.0, 2.0, 7, 2.5),  # exactly at the threshold is no anomaly
        (10.1, 5.0, 2.0, 7, 2.55),
        (8.0, 1.0, 0.0, 7, 3.5),  # constant history, jump up
        (100.0, 1.0, 0.0, 7, 5.0),  # capped
        (0.0, 4.0, 0.0, 7, -0.8),
        (4.0, 4.0, 0.0, 7, 0.0),
    ]
    df = spark.createDataFrame(
        [r[:4] for r in rows], "actual_demand double, rolling_mean_14 double, rolling_volatility double, history_count long"
    )
    got = an.zscore(df).collect()
    assert [r["z_score"] for r in got] == [r[4] for r in rows]
    assert [r["is_zscore_anomaly"] for r in got] == [False, False, True, True, True, False, False]


def test_residuals_without_expectation(spark):
    df = spark.createDataFrame([(5.0, 0.0, None), (0.0, 0.0, 1.0), (6.0, 4.0, 1.0)], "actual_demand double, expected_demand double, rolling_std_14 double")
    got = an.residual_features(df).collect()
    assert [r["relative_residual"] for r in got] == [1.0, 0.0, 0.5]
    assert got[0]["rolling_volatility"] == 0.0


def test_expected_column_order(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "pred_ma_7 double, pred_ridge double")
    assert an.pick_expected(df) == "pred_ridge"
    assert an.pick_expected(df, "pred_ma_7") == "pred_ma_7"
    with pytest.raises(KeyError):
        an.pick_expected(df.select(F.lit(1).alias("x")))


def test_export_keeps_the_most_severe_row(spark):
    base = ("2022-07-01", 5, "Delhi", 1.0, 2.0)
    rows = [(*base, 0.9, an.SPIKE, "LOW", "x"), (*base, 0.1, an.DROP, "CRITICAL", "y")]
    df = spark.createDataFrame(
        rows,
        "date_ string, product_id int, city_name string, actual_demand double, expected_demand double, anomaly_score double, anomaly_type string, severity string, action_recommendation string",
    )
    got = an.export_anomalies(df).collect()
    assert len(got) == 1 and got[0]["severity"] == "CRITICAL" and got[0]["product_id"] == "5"


def test_sbc_classes(spark):
    days = [f"2022-04-{d:02d}" for d in range(1, 21)]
    rows = [("smooth", d, 10.0 + i % 2) for i, d in enumerate(days)]
    rows += [("erratic", d, 1.0 if i % 4 else 40.0) for i, d in enumerate(days)]
    rows += [("rare", d, 5.0) for d in days[::3]]
    rows += [("lumpy", d, 1.0 if i % 2 else 60.0) for i, d in enumerate(days[::3])]
    rows += [("late", "2022-05-01", 9.0)]
    df = spark.createDataFrame([(p, "c", d, q) for p, d, q in rows], "product_id string, city_name string, date_ string, daily_quantity double")
    df = df.withColumn("date_", F.col("date_").cast("date"))
    got = {r["product_id"]: r for r in sbc_classify(df, "2022-04-01", "2022-04-21").collect()}
    assert {k: r["demand_category"] for k, r in got.items()} == {
        "smooth": "Smooth", "erratic": "Erratic", "rare": "Intermittent", "lumpy": "Lumpy", "late": "Intermittent",
    }
    assert got["late"]["adi"] == 20.0 and got["late"]["zero_sales_pct"] == 100.0
    assert got["rare"]["adi"] == round(20 / 7, 3)


def test_weather_bands(spark):
    rows = [(35.0, 50.0, 90.0), (5.0, 50.0, 90.0), (0.1, 50.0, 90.0), (0.0, 40.0, 90.0), (0.0, 35.0, 90.0), (0.0, 34.9, 75.0), (0.0, 34.9, 74.9)]
    df = spark.createDataFrame(rows, "rainfall_mm double, temperature_max double, humidity double")
    assert column(external.weather_condition(df), "weather_condition") == [
        "Heavy Rain", "Rain / Monsoon Shower", "Light Rain", "Extreme Heatwave", "Hot / Sunny", "Humid / Overcast", "Clear / Pleasant",
    ]


def test_unmatched_classes(spark):
    rows = [(50, 2, 2, 1.0, 2.0, 9.0), (10, 1, 2, 1.0, 2.0, 9.0), (10, 1, 1, 1.0, 2.0, 9.0), (5, 1, 1, 0.0, 0.0, 9.0),
            (2, 1, 1, 0.0, 0.0, 9.0), (2, 1, 1, 0.0, 1.0, 9.0), (1, 1, 1, 1.0, 1.0, 0.0), (1, 1, 1, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "total_rows long, num_cities long, num_months long, min_price double, max_price double, total_qty double")
    assert [c[0] for c in column(audits.classify_unmatched(df), "classification")] == list("AABBCBCD")


def test_verdict_order(spark):
    names = ["row_count", "date_parse_failures", "missing_product_id", "missing_quantity", "missing_price", "negative_quantity", "negative_price"]
    rows = [(0, 1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 1, 1), (1, 0, 1, 1, 1, 1, 1), (1, 0, 0, 1, 1, 1, 1), (1, 0, 0, 0, 1, 1, 1),
            (1, 0, 0, 0, 0, 1, 1), (1, 0, 0, 0, 0, 0, 1), (1, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    assert column(df.select(profiling.verdict().alias("v")), "v") == [
        "FAIL - EMPTY", "REVIEW - DATE PARSING", "REVIEW - MISSING PRODUCT IDS", "REVIEW - MISSING QUANTITY",
        "REVIEW - MISSING PRICE", "REVIEW - NEGATIVE QUANTITY", "REVIEW - NEGATIVE PRICE", "PASS - BASIC QUALITY",
    ]


def test_validation_codes(spark):
    columns = validation.SALES_COLUMNS
    base = dict(zip(columns, ["2022-04-01", "Delhi", "o1", "c1", "k1", "2", "10", "0", "7", ""]))
    cases = {
        "fine": {}, "again": {"order_id": "fine"},
        "no_date": {"date_": " "}, "bad_date": {"date_": "32/01/2022"}, "no_id": {"product_id": ""}, "bad_id": {"product_id": "x"},
        "float_id": {"product_id": "7.0"}, "unknown": {"product_id": "8"}, "no_qty": {"procured_quantity": None},
        "bad_qty": {"procured_quantity": "two"}, "minus_qty": {"procured_quantity": "-1"}, "zero_qty": {"procured_quantity": "0"},
        "minus_price": {"unit_selling_price": "-0.5"}, "bad_discount": {"total_discount_amount": "1,5"},
        "all": {"date_": "", "product_id": "", "procured_quantity": "", "unit_selling_price": "", "total_discount_amount": ""},
    }
    rows = []
    for name, change in cases.items():
        row = base | {"order_id": name} | change
        rows.append(tuple(row[c] for c in columns))
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).withColumn("Unnamed: 0", F.lit("1"))
    products = spark.createDataFrame([(7,)], "product_id long")
    got = validation.validate_rows(raw, products).collect()
    errors = {r["order_id"]: r["errors"] for r in got if "duplicate_row" not in r["errors"]}
    assert errors == {
        "fine": [], "float_id": [], "zero_qty": [], "no_date": ["missing_date"], "bad_date": ["invalid_date"],
        "no_id": ["missing_product_id"], "bad_id": ["invalid_product_id"], "unknown": ["unmatched_product_id"],
        "no_qty": ["missing_quantity"], "bad_qty": ["invalid_quantity"], "minus_qty": ["negative_quantity"],
        "minus_price": ["negative_price"], "bad_discount": ["invalid_discount"],
        "all": ["missing_date", "missing_product_id", "missing_quantity", "missing_price", "missing_discount"],
    }
    repeated = [r for r in got if "duplicate_row" in r["errors"]]
    assert [(r["order_id"], r["copies"]) for r in repeated] == [("fine", 1)]
    with pytest.raises(ValueError, match="city_name"):
        validation.validate_rows(raw.drop("city_name"), products)


def test_a_job_without_valid_rows_fails(spark):
    columns = validation.SALES_COLUMNS
    raw = spark.createDataFrame([("",) * 10], ", ".join(f"{c} string" for c in columns))
    products = spark.createDataFrame([(7,)], "product_id long")
    row = validation.job_status(validation.validate_rows(raw, products)).first()
    assert (row["status"], row["total_rows"], row["processed_rows"]) == ("FAILED", 1, 0) and row["error_summary"]


def test_model_families(spark):
    names = ["Stacking Ensemble", "XGBoost (Early Stopped)", "Prophet", "Moving Average (7 Days)", "Ridge Regression", "Naive", ""]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    assert column(model_family(df), "family") == [
        "Meta-Ensemble", "Gradient Boosted Trees", "Additive Seasonality", "Time-Series Heuristic", "Linear Regularized",
        "Statistical Baseline", "Model",
    ]


def test_message_rules(spark):
    cases = {
        "What is the stockout risk in Delhi for SKU 19512?": ("english", "STOCKOUT_INVENTORY", "inventory_health", [19512], ["Delhi"]),
        "why?": ("english", "GENERAL_INTELLIGENCE", "why_inquiry", [], []),
        "मुझे बिक्री दिखाओ": ("hindi", "GENERAL_INTELLIGENCE", "demand", [], []),
        "माझी मागणी कशी आहे": ("marathi", "GENERAL_INTELLIGENCE", "demand", [], []),
        "mala profit dakhav in bangalore please now": ("marathi", "GENERAL_INTELLIGENCE", "profit", [], ["Bengaluru"]),
        "sabse zyada revenue kisko": ("hinglish", "SALES_REVENUE", "product_performance", [], []),
        "profit margin of 391306 and 12 in gurgaon and mumbai": ("english", "GENERAL_INTELLIGENCE", "margin", [391306], ["Mumbai", "HR-NCR"]),
        "in delhi which sku sells": ("english", "PRODUCT_SEARCH", "demand", [], ["Delhi"]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    tagged = messages.tag_language(df)
    short = {r["text"]: r["intent"] for r in messages.tag_intent(df).collect()}
    long_ = {r["text"]: r["intent"] for r in messages.tag_business_intent(df).collect()}
    found = {r["text"]: r for r in messages.extract_entities(df).collect()}
    for row in tagged.collect():
        text = row["text"]
        language, intent, business, ids, cities = cases[text]
        assert row["language"] == language, text
        assert (short[text], long_[text]) == (intent, business), text
        assert (found[text]["product_ids"], found[text]["cities"]) == (ids, cities), text


def test_follow_up_keeps_the_intent(spark):
    df = spark.createDataFrame(
        [("and in Mumbai", "forecast"), ("please show me all the numbers of the quarter", "forecast"), ("and in Mumbai", None)],
        "text string, previous string",
    )
    got = messages.tag_business_intent(df, context_intent="previous").collect()
    assert [r["intent"] for r in got] == ["city_performance", "demand", "city_performance"]
    df = df.withColumn("text", F.regexp_replace("text", "and in Mumbai", "same for others"))
    assert column(messages.tag_business_intent(df, context_intent="previous"), "intent") == ["forecast", "demand", "demand"]


def test_citations(spark):
    df = spark.createDataFrame([('{"citations": [{"type": "sales", "product_id": 5}]}',), ("broken",), (None,), ("{}",)], "retrieved_context string")
    got = messages.parse_citations(df).collect()
    assert [len(r["citations"]) for r in got] == [1, 0, 0, 0]
    assert got[0]["citations"][0]["product_id"] == 5
