"""Time-series feature and external-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.catalog.views import CUT_DAY, FIRST_DAY, LAST_DAY, LINES, PANEL, grid
from stockloom.operators import external as x
from stockloom.operators import features as f

GRID = PANEL + ",\n" + grid("panel", FIRST_DAY, LAST_DAY)


def _lags(*sizes):
    return ", ".join(f"LAG(daily_quantity, {n}) OVER w AS lag_{n}" for n in sizes)


def _frame(n):
    return f"(PARTITION BY product_id, city_name ORDER BY date_ ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _means(*sizes, digits=6):
    return ", ".join(f"ROUND(AVG(daily_quantity) OVER {_frame(n)}, {digits}) AS rolling_mean_{n}" for n in sizes)


def _stds(*sizes, digits=6):
    return ", ".join(
        f"ROUND(COALESCE(STDDEV_SAMP(daily_quantity) OVER {_frame(n)}, 0.0), {digits}) AS rolling_std_{n}" for n in sizes
    )


W = "WINDOW w AS (PARTITION BY product_id, city_name ORDER BY date_)"
CALENDAR = (
    "CAST(isodow(date_) - 1 AS INTEGER) AS day_of_week, CAST(isodow(date_) >= 6 AS INTEGER) AS is_weekend,"
    " CAST(dayofmonth(date_) AS INTEGER) AS day_of_month"
)
ALL_FEATURES = f"date_, product_id, city_name, daily_quantity, {_lags(1, 7, 14, 28)}, {_means(7, 14, 28)}, {_stds(7)}, {CALENDAR}"
FRAME = f"features AS (SELECT * FROM (SELECT {ALL_FEATURES} FROM grid {W}) WHERE lag_28 IS NOT NULL)"


def rounded(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in df.columns if c.startswith("rolling_")})


def panel_grid(t):
    return f.calendar_grid(t.panel, t.days.first, t.days.last)


def panel_features(t):
    return f.feature_frame(panel_grid(t))


@query("fea01_calendar_grid", f"WITH {GRID} SELECT date_, product_id, city_name, daily_quantity FROM grid")
def _(t):
    return panel_grid(t)


@query(
    "fea01_observed_days_grid",
    f"""WITH {GRID} SELECT date_, product_id, city_name, daily_quantity FROM grid WHERE date_ IN (SELECT date_ FROM panel)""",
)
def _(t):
    return f.calendar_grid(t.panel, t.days.first, t.days.last, skip_unobserved=True)


@query(
    "fea02_series_pool",
    f"""WITH {PANEL} SELECT product_id, city_name, COUNT(*) AS active_days, SUM(daily_quantity) AS total_qty FROM panel GROUP BY 1, 2
    ORDER BY active_days DESC, total_qty DESC, product_id, city_name LIMIT 10""",
)
def _(t):
    return f.series_pool(t.panel, 10)


@query("fea03_lags", f"WITH {GRID} SELECT date_, product_id, city_name, daily_quantity, {_lags(1, 7, 14, 28)} FROM grid {W}")
def _(t):
    return f.add_lags(panel_grid(t), [1, 7, 14, 28])


@query("fea04_rolling_mean", f"WITH {GRID} SELECT date_, product_id, city_name, daily_quantity, {_means(7, 14, 28)} FROM grid")
def _(t):
    return rounded(f.add_rolling_mean(panel_grid(t), [7, 14, 28]))


@query(
    "fea04_rolling_mean_full",
    f"""WITH {GRID} SELECT date_, product_id, city_name, daily_quantity, CASE WHEN COUNT(*) OVER {_frame(14)} = 14
    THEN ROUND(AVG(daily_quantity) OVER {_frame(14)}, 6) END AS rolling_mean_14 FROM grid""",
)
def _(t):
    return rounded(f.add_rolling_mean(panel_grid(t), [14], full=True))


@query("fea05_rolling_std", f"WITH {GRID} SELECT date_, product_id, city_name, daily_quantity, {_stds(7, 14, 28)} FROM grid")
def _(t):
    return rounded(f.add_rolling_std(panel_grid(t), [7, 14, 28]))


@query("fea06_calendar_columns", f"WITH {GRID} SELECT date_, product_id, city_name, daily_quantity, {CALENDAR} FROM grid")
def _(t):
    return f.add_calendar(panel_grid(t))


@query("fea07_feature_frame", f"WITH {GRID}, {FRAME} SELECT * FROM features")
def _(t):
    return rounded(panel_features(t))


@query(
    "fea08_observation_features",
    f"""WITH {PANEL} SELECT * FROM (SELECT date_, product_id, city_name, daily_quantity, {_lags(1, 7, 14, 28)}, {_means(7, 14, 28)},
    {_stds(7, 14, 28)}, {CALENDAR} FROM panel {W}) WHERE lag_28 IS NOT NULL AND daily_quantity > 0""",
)
def _(t):
    return rounded(f.observation_features(t.panel))


@query(
    "fea09_chronological_split",
    f"""WITH {GRID}, {FRAME} SELECT CASE WHEN date_ < {CUT_DAY} THEN 'train' ELSE 'validation' END AS part, COUNT(*) AS row_count,
    MIN(date_) AS first_date, MAX(date_) AS last_date, SUM(daily_quantity) AS quantity FROM features GROUP BY 1""",
)
def _(t):
    train, validation = f.split_by_date(panel_features(t), t.days.cut)
    parts = train.withColumn("part", F.lit("train")).unionByName(validation.withColumn("part", F.lit("validation")))
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date_").alias("first_date"),
        F.max("date_").alias("last_date"),
        F.sum("daily_quantity").alias("quantity"),
    )


@query(
    "fea10_feature_audit",
    f"""WITH {GRID}, s AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT product_id, city_name FROM grid))
    SELECT (SELECT n FROM s) AS series, (SELECT n FROM s) * ({LAST_DAY} - {FIRST_DAY} + 1) AS expected_rows, COUNT(*) AS actual_rows, COUNT(*) FILTER (daily_quantity = 0) AS zero_rows,
    COUNT(*) - COUNT(daily_quantity) AS null_rows, MIN(date_) AS first_date, MAX(date_) AS last_date, CAST(0 AS BIGINT) AS incomplete_series FROM grid""",
)
def _(t):
    return f.feature_audit(panel_grid(t), t.days.first, t.days.last)


@query(
    "fea11_cap_sample",
    f"""WITH {GRID}, {FRAME} SELECT * FROM features ORDER BY CAST('0x' || substr(md5(product_id || '|' || city_name || '|' ||
    CAST(date_ AS VARCHAR) || '|42'), 1, 8) AS BIGINT), product_id, city_name, date_ LIMIT 2000""",
)
def _(t):
    return rounded(f.cap_sample(panel_features(t), 2000, ["product_id", "city_name", "date_"]))


_DATES = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_ FROM orders)"
_HOLIDAYS = """holidays AS (
  SELECT date_, 'national' AS scope, NULL AS region, 'Nation ' || CAST(dayofyear(date_) AS VARCHAR) AS holiday_name FROM dates WHERE dayofyear(date_) % 45 = 0
  UNION ALL SELECT date_, 'restricted', NULL, 'Restricted ' || CAST(month(date_) AS VARCHAR) FROM dates WHERE dayofyear(date_) % 60 = 0
  UNION ALL SELECT date_, 'state', 'ASIA', 'Asia day' FROM dates WHERE dayofmonth(date_) = 9
  UNION ALL SELECT date_, 'state', 'EUROPE', 'Europe day' FROM dates WHERE dayofmonth(date_) IN (9, 21))"""


@query(
    "fea12_holiday_features",
    f"""WITH {_DATES}, {_HOLIDAYS}, j AS (SELECT d.date_, MIN(holiday_name) FILTER (scope = 'national') AS n, MIN(holiday_name) FILTER (scope = 'restricted') AS r,
      MIN(holiday_name) FILTER (region = 'ASIA') AS a, MIN(holiday_name) FILTER (region = 'EUROPE') AS e
      FROM dates d LEFT JOIN holidays h ON d.date_ = h.date_ GROUP BY 1)
    SELECT date_, CAST(isodow(date_) - 1 AS INTEGER) AS day_of_week, CAST(month(date_) AS INTEGER) AS month, CAST(quarter(date_) AS INTEGER) AS quarter,
    CAST(year(date_) AS INTEGER) AS year, CAST(isodow(date_) >= 6 AS INTEGER) AS is_weekend, CAST(n IS NOT NULL AS INTEGER) AS is_holiday_national,
    CASE WHEN n IS NOT NULL THEN 'Gazetted' WHEN r IS NOT NULL THEN 'Restricted' WHEN COALESCE(a, e) IS NOT NULL THEN 'State' ELSE 'None' END AS holiday_type,
    CAST(COALESCE(n, r, a, e) IS NOT NULL AS INTEGER) AS is_holiday, COALESCE(n, r, a, e, 'None') AS holiday_name,
    CASE WHEN month(date_) IN (4, 5) THEN 'Summer' ELSE 'Monsoon' END AS season FROM j""",
)
def _(t):
    dates = t.read("orders").select(F.to_date("o_orderdate").alias("date_")).distinct()
    doy, dom = F.dayofyear("date_"), F.dayofmonth("date_")

    def entry(condition, scope, region, name):
        fields = F.struct(F.lit(scope).alias("scope"), F.lit(region).cast("string").alias("region"), name.alias("holiday_name"))
        return F.when(condition, fields)

    entries = F.array_compact(
        F.array(
            entry(doy % 45 == 0, "national", None, F.concat(F.lit("Nation "), doy.cast("string"))),
            entry(doy % 60 == 0, "restricted", None, F.concat(F.lit("Restricted "), F.month("date_").cast("string"))),
            entry(dom == 9, "state", "ASIA", F.lit("Asia day")),
            entry(dom.isin(9, 21), "state", "EUROPE", F.lit("Europe day")),
        )
    )
    holidays = dates.select("date_", F.inline(entries))
    return x.holiday_features(dates, holidays, ["ASIA", "EUROPE"])


_WEATHER = """weather AS (SELECT CAST(o_orderdate AS DATE) AS date_, o_orderpriority AS city_name,
  CAST(MAX(o_custkey % 60) AS DOUBLE) - 20.0 AS rainfall_mm, CAST(MAX(o_orderkey % 45) AS DOUBLE) AS temperature_max,
  CAST(MIN(o_custkey % 100) AS DOUBLE) AS humidity FROM orders GROUP BY 1, 2)"""


def _weather(t):
    days = t.read("orders").groupBy(F.to_date("o_orderdate").alias("date_"), F.col("o_orderpriority").alias("city_name"))
    return days.agg(
        (F.max(F.col("o_custkey") % 60).cast("double") - 20.0).alias("rainfall_mm"),
        F.max(F.col("o_orderkey") % 45).cast("double").alias("temperature_max"),
        F.min(F.col("o_custkey") % 100).cast("double").alias("humidity"),
    )


@query(
    "fea13_weather_condition",
    f"""WITH {_WEATHER} SELECT *, CASE WHEN rainfall_mm >= 35 THEN 'Heavy Rain' WHEN rainfall_mm >= 5 THEN 'Rain / Monsoon Shower'
    WHEN rainfall_mm > 0 THEN 'Light Rain' WHEN temperature_max >= 40 THEN 'Extreme Heatwave' WHEN temperature_max >= 35 THEN 'Hot / Sunny'
    WHEN humidity >= 75 THEN 'Humid / Overcast' ELSE 'Clear / Pleasant' END AS weather_condition FROM weather""",
)
def _(t):
    return x.weather_condition(_weather(t))


@query(
    "fea14_city_commodity",
    f"""WITH {LINES} SELECT order_date AS date_, CASE lower(r_name) WHEN 'asia' THEN 'Mumbai' ELSE 'Delhi' END AS project_city, p_type AS commodity_name,
    l_returnflag AS category, l_extendedprice AS price_per_kg, 'INR ' || printf('%.2f', l_extendedprice) || ' per KG' AS price_per_unit,
    r_name || ' (' || CASE lower(r_name) WHEN 'asia' THEN 'Mumbai' ELSE 'Delhi' END || ')' AS market_name FROM lines
    WHERE r_name IN ('ASIA', 'EUROPE') AND order_date BETWEEN DATE '2000-04-01' AND DATE '2000-07-31'""",
)
def _(t):
    prices = t.lines.select(
        F.col("order_date").alias("date_"),
        F.col("r_name").alias("market"),
        F.col("p_type").alias("commodity"),
        F.col("l_returnflag").alias("category"),
        F.col("l_extendedprice").alias("price"),
        F.lit("KG").alias("unit"),
    )
    return x.city_commodity(prices, {"asia": "Mumbai", "europe": "Delhi"}, "2000-04-01", "2000-07-31")


_PRIORITIES = {"1-URGENT": "Grains", "2-HIGH": "Edible Oils", "3-MEDIUM": "Sugar"}


@query(
    "fea15_benchmark_long",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date_, strftime(o_orderdate, '%YM%m') AS month_code, o_orderpriority AS commodity_name,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Grains' WHEN '2-HIGH' THEN 'Edible Oils' ELSE 'Sugar' END AS category,
    ROUND(MAX(o_totalprice), 4) AS benchmark_price_usd, '$/mt' AS unit FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2, 3""",
)
def _(t):
    month = F.date_format("o_orderdate", "yyyy'M'MM").alias("month_code")
    wide = t.read("orders").groupBy(month).pivot("o_orderpriority", [*_PRIORITIES, "5-LOW"]).agg(F.max("o_totalprice"))
    meta = t.spark.createDataFrame(
        [(c, g, "$/mt") for c, g in _PRIORITIES.items()], "commodity_name string, category string, unit string"
    )
    return x.benchmark_long(wide, meta)


@query(
    "fea16_join_external",
    f"""WITH {PANEL}, cal AS (SELECT DISTINCT order_date AS date_, CAST(dayofmonth(order_date) IN (1, 15) AS INTEGER) AS is_holiday FROM lines),
    quotes AS (SELECT r_name AS city_name, order_date AS date_, MAX(l_extendedprice) AS price_level FROM lines
      WHERE dayofmonth(order_date) = 1 OR (r_name = 'ASIA' AND dayofmonth(order_date) = 17) GROUP BY 1, 2),
    wx AS (SELECT r_name AS city_name, order_date AS date_, MAX(l_quantity) AS rainfall_mm FROM lines WHERE dayofmonth(order_date) <> 8 GROUP BY 1, 2)
    SELECT p.date_, p.product_id, p.city_name, daily_quantity, is_holiday, rainfall_mm,
    (SELECT MAX_BY(price_level, q.date_) FROM quotes q WHERE q.city_name = p.city_name AND q.date_ <= p.date_) AS price_level
    FROM panel p LEFT JOIN cal c ON p.date_ = c.date_ LEFT JOIN wx ON wx.city_name = p.city_name AND wx.date_ = p.date_""",
)
def _(t):
    dom = F.dayofmonth("order_date")
    city, day = F.col("r_name").alias("city_name"), F.col("order_date").alias("date_")
    calendar = t.lines.select(day).distinct().withColumn("is_holiday", F.dayofmonth("date_").isin(1, 15).cast("int"))
    quoted = t.lines.where((dom == 1) | ((F.col("r_name") == "ASIA") & (dom == 17)))
    quotes = quoted.groupBy(city, day).agg(F.max("l_extendedprice").alias("price_level"))
    weather = t.lines.where(dom != 8).groupBy(city, day).agg(F.max("l_quantity").alias("rainfall_mm"))
    return x.join_external(t.panel, calendar, weather, quotes)
