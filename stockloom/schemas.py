"""Table layouts and column contracts."""

from __future__ import annotations

from pyspark.sql import types as T

SERIES_KEY = ["product_id", "city_name"]
GRAIN = ["date_", "product_id", "city_name"]

SALES = T.StructType(
    [
        T.StructField("date_", T.DateType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("cart_id", T.StringType()),
        T.StructField("dim_customer_key", T.StringType()),
        T.StructField("procured_quantity", T.DoubleType()),
        T.StructField("unit_selling_price", T.DoubleType()),
        T.StructField("total_discount_amount", T.DoubleType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("total_weighted_landing_price", T.DoubleType()),
    ]
)
SALES_COLUMNS = SALES.fieldNames()
SALES_MEASURES = [
    "procured_quantity",
    "unit_selling_price",
    "total_discount_amount",
    "total_weighted_landing_price",
]
SALES_ESSENTIALS = ["date_", "product_id", "procured_quantity", "unit_selling_price"]
# Index columns that spreadsheet exports leave behind.
STRAY_COLUMNS = ["Unnamed: 0", "Unnamed: 0.1"]

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("brand_name", T.StringType()),
        T.StructField("manufacturer_name", T.StringType()),
        T.StructField("l0_category", T.StringType()),
        T.StructField("l1_category", T.StringType()),
        T.StructField("l2_category", T.StringType()),
        T.StructField("l0_category_id", T.IntegerType()),
        T.StructField("l1_category_id", T.IntegerType()),
        T.StructField("l2_category_id", T.IntegerType()),
    ]
)

# External feature tables, by kind.
EXTERNAL = {
    "calendar": T.StructType(
        [
            T.StructField("date_", T.DateType()),
            T.StructField("day_of_week", T.IntegerType()),
            T.StructField("month", T.IntegerType()),
            T.StructField("quarter", T.IntegerType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("is_weekend", T.IntegerType()),
            T.StructField("is_holiday", T.IntegerType()),
            T.StructField("holiday_name", T.StringType()),
            T.StructField("season", T.StringType()),
        ]
    ),
    "weather": T.StructType(
        [
            T.StructField("date_", T.DateType()),
            T.StructField("city_name", T.StringType()),
            T.StructField("temperature_avg", T.DoubleType()),
            T.StructField("temperature_max", T.DoubleType()),
            T.StructField("temperature_min", T.DoubleType()),
            T.StructField("humidity", T.DoubleType()),
            T.StructField("rainfall_mm", T.DoubleType()),
            T.StructField("weather_condition", T.StringType()),
        ]
    ),
    "commodity": T.StructType(
        [
            T.StructField("date_", T.DateType()),
            T.StructField("month_code", T.StringType()),
            T.StructField("commodity_name", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("benchmark_price_usd", T.DoubleType()),
            T.StructField("unit", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("source_url", T.StringType()),
        ]
    ),
}

# Accepted spellings of each contract column, first match wins.
ALIASES = {
    "date_": ["date_", "date", "transaction_date"],
    "product_id": ["product_id", "sku", "item_id"],
    "procured_quantity": ["procured_quantity", "quantity", "qty"],
    "unit_selling_price": ["unit_selling_price", "selling_price", "price"],
}
# Contract columns found by a word inside the column name.
ALIAS_WORDS = {
    "total_weighted_landing_price": "landing",
    "city_name": "city",
}
