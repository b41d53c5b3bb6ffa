"""Source and sink queries: data goes out to files and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.catalog.registry import query
from stockloom.catalog.views import PRODUCTS, RAW, SALES
from stockloom.schemas import SALES_COLUMNS
from stockloom.session import scratch_path
from stockloom.sources import readers, sinks, snapshots

_TEXT_IDS = ["order_id", "cart_id", "dim_customer_key"]


def _typed(t):
    return t.sales.withColumns({c: F.col(c).cast("string") for c in _TEXT_IDS}).select(*SALES_COLUMNS)


def _by_city_day(df):
    return df.groupBy("city_name", "date_").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("procured_quantity").alias("quantity"),
        F.round(F.sum(F.col("procured_quantity") * F.col("unit_selling_price")), 2).alias("revenue"),
        F.count("total_weighted_landing_price").alias("costed_rows"),
        F.max("order_id").alias("max_order"),
    )


_CITY_DAY = """SELECT city_name, date_, COUNT(*) AS row_count, SUM(procured_quantity) AS quantity,
  ROUND(SUM(procured_quantity * unit_selling_price), 2) AS revenue, COUNT(total_weighted_landing_price) AS costed_rows,
  MAX(CAST(order_id AS VARCHAR)) AS max_order FROM sales GROUP BY 1, 2"""


@query("src01_read_sales_csv", f"WITH {SALES} {_CITY_DAY}")
def _(t):
    path = scratch_path(t.spark, "sales")
    sinks.write_table(_typed(t), path, "csv")
    return _by_city_day(readers.read_sales(t.spark, path))


@query("src02_read_many_files", f"WITH {SALES} {_CITY_DAY}")
def _(t):
    path = scratch_path(t.spark, "sales-by-city")
    sinks.write_table(_typed(t).withColumn("hub", F.col("city_name")), path, "csv", partition_by=["hub"])
    return _by_city_day(readers.read_sales(t.spark, f"{path}/*/*.csv"))


@query("src03_source_file", "SELECT COUNT(*) AS row_count, COUNT(*) AS tagged_rows FROM lineitem")
def _(t):
    tagged = readers.with_source_file(t.read("lineitem"))
    return tagged.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("source_file").endswith(".parquet")).alias("tagged_rows"),
    )


@query(
    "src04_file_manifest",
    f"""WITH {SALES}, found AS (SELECT 'sales_' || lower(city_name) AS file, COUNT(*) AS n FROM sales GROUP BY 1),
    wanted AS (SELECT UNNEST(['sales_asia', 'sales_europe', 'sales_america', 'sales_atlantis']) AS file)
    SELECT w.file, COALESCE(n, 0) AS row_count, CASE WHEN n IS NULL THEN 'FILE NOT FOUND' ELSE 'FOUND' END AS status
    FROM wanted w LEFT JOIN found f ON w.file = f.file""",
)
def _(t):
    name = F.concat(F.lit("sales_"), F.lower("city_name"), F.lit(".csv"))
    tagged = t.sales.select(name.alias("source_file"))
    return readers.file_manifest(["sales_asia", "sales_europe", "sales_america", "sales_atlantis"], tagged)


@query(
    "src05_read_raw_strings",
    f"""WITH {RAW} SELECT city_name, COUNT(*) AS row_count, COUNT(NULLIF(TRIM(product_id), '')) AS filled_ids,
    COUNT(DISTINCT procured_quantity) FILTER (TRIM(procured_quantity) <> '') AS quantity_texts,
    CAST(10 AS INTEGER) AS column_count FROM raw GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "raw")
    sinks.write_table(t.raw_sales.withColumn("Unnamed: 0", F.lit("7")), path, "csv")
    raw = readers.read_raw_strings(t.spark, path)
    return raw.groupBy("city_name").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.nullif(F.trim("product_id"), F.lit(""))).alias("filled_ids"),
        F.countDistinct(F.when(F.trim("procured_quantity") != "", F.col("procured_quantity"))).alias("quantity_texts"),
        F.lit(len(raw.columns)).alias("column_count"),
    )


@query("src06_resolve_aliases", f"WITH {SALES} {_CITY_DAY}")
def _(t):
    renamed = _typed(t).withColumnsRenamed(
        {
            "date_": "Transaction_Date",
            "product_id": "SKU",
            "procured_quantity": "Qty",
            "unit_selling_price": "Selling_Price",
            "total_weighted_landing_price": "Landing_Cost",
            "city_name": "City",
        }
    )
    return _by_city_day(readers.resolve_aliases(renamed))


@query(
    "src07_pruned_scan",
    "SELECT l_partkey AS product_id, SUM(l_quantity) AS quantity FROM lineitem GROUP BY 1",
)
def _(t):
    lines = t.read("lineitem").select(F.col("l_partkey").alias("product_id"), "l_quantity")
    return lines.groupBy("product_id").agg(F.sum("l_quantity").alias("quantity"))


@query(
    "src08_read_products",
    """SELECT p_partkey AS product_id, p_name AS product_name, NULLIF(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END, '')
    AS brand_name, p_type AS l0_category, CAST(p_size AS INTEGER) AS l0_category_id, TRUE AS is_active FROM part
    WHERE p_partkey % 13 <> 0""",
)
def _(t):
    part = F.col("p_partkey")
    text = t.read("part").select(
        F.concat(part.cast("string"), F.lit(".0")).alias("product_id"),
        F.when(part % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("product_name"),
        F.when(part % 7 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("brand_name"),
        F.col("p_type").alias("l0_category"),
        F.col("p_size").cast("string").alias("l0_category_id"),
    )
    path = scratch_path(t.spark, "products")
    sinks.write_table(text, path, "csv")
    return readers.read_products(t.spark, path)


@query(
    "src09_read_external",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date_, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
    CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
    CAST(0 AS INTEGER) AS is_holiday, 'None' AS holiday_name,
    CASE WHEN month(o_orderdate) IN (4, 5) THEN 'Summer' ELSE 'Monsoon' END AS season FROM orders""",
)
def _(t):
    day = F.col("date_")
    calendar = (
        t.read("orders")
        .select(F.to_date("o_orderdate").alias("date_"))
        .distinct()
        .select(
            "date_",
            F.weekday(day).alias("day_of_week"),
            F.month(day).alias("month"),
            F.quarter(day).alias("quarter"),
            F.year(day).alias("year"),
            (F.weekday(day) >= 5).cast("int").alias("is_weekend"),
            F.lit(0).alias("is_holiday"),
            F.lit("None").alias("holiday_name"),
            F.when(F.month(day).isin(4, 5), "Summer").otherwise("Monsoon").alias("season"),
        )
    )
    path = scratch_path(t.spark, "calendar")
    sinks.write_table(calendar, path, "csv")
    return readers.read_external(t.spark, "calendar", path)


@query("snk01_write_table", f"WITH {SALES} {_CITY_DAY}")
def _(t):
    path = scratch_path(t.spark, "sales-table")
    sinks.write_table(_typed(t), path, "parquet", partition_by=["city_name"])
    return _by_city_day(readers.read_sales(t.spark, path, "parquet"))


@query("snk02_append_batches", f"WITH {SALES} {_CITY_DAY}")
def _(t):
    path = scratch_path(t.spark, "sales-batches")
    sales = _typed(t)
    cut = F.lit("1998-01-01").cast("date")
    sinks.write_table(sales.where(F.col("date_") < cut), path, "csv")
    sinks.write_table(sales.where(F.col("date_") >= cut), path, "csv", mode="append")
    return _by_city_day(readers.read_sales(t.spark, path))


@query(
    "snk03_metrics_json",
    """SELECT 'lines' AS metric, '{"rows":' || COUNT(*) || '}' AS value FROM lineitem
    UNION ALL SELECT 'flags', '{"flag":"' || l_returnflag || '","rows":' || COUNT(*) || '}' FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    lines = t.read("lineitem")
    count = F.count(F.lit(1)).alias("rows")
    metrics = {"lines": lines.agg(count), "flags": lines.groupBy(F.col("l_returnflag").alias("flag")).agg(count)}
    path = scratch_path(t.spark, "metrics")
    sinks.write_metrics(metrics, path)
    return t.spark.read.schema("metric string, value string").json(path)


@query("snk04_publish", "SELECT p_type, COUNT(*) AS parts FROM part GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "published")
    checks = {"null_ids": (F.count_if(F.col("p_partkey").isNull()), 0)}
    snapshots.publish_snapshot(t.read("part").limit(0), path, checks)
    snapshots.publish_snapshot(t.read("part"), path, checks)
    return snapshots.read_snapshot(t.spark, path).groupBy("p_type").agg(F.count(F.lit(1)).alias("parts"))


_UPDATES = """updates AS (SELECT l_partkey AS product_id, 'sold ' || CAST(MAX(l_orderkey) AS VARCHAR) AS product_name
  FROM lineitem GROUP BY 1)"""


@query(
    "snk05_upsert",
    f"""WITH {PRODUCTS}, {_UPDATES} SELECT product_id, product_name FROM products p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.product_id = p.product_id)
    UNION ALL SELECT product_id, product_name FROM updates""",
)
def _(t):
    return sinks.upsert(t.products.select("product_id", "product_name"), _sold(t), ["product_id"], "seen_at")


def _sold(t):
    """The newest order of every part that was sold, as a new name."""
    return t.read("lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("sold "), F.col("l_orderkey").cast("string")).alias("product_name"),
        F.col("l_orderkey").alias("seen_at"),
    )


@query(
    "snk05_stored_upsert",
    f"""WITH {PRODUCTS}, {_UPDATES} SELECT product_id, product_name FROM products p WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.product_id = p.product_id)
    UNION ALL SELECT product_id, product_name FROM updates""",
)
def _(t):
    path = scratch_path(t.spark, "products")
    snapshots.publish_snapshot(t.products.select("product_id", "product_name"), path, keys=["product_id"])
    snapshots.upsert_snapshot(path, _sold(t), "seen_at")
    return snapshots.read_snapshot(t.spark, path)


@query(
    "snk06_insert_missing",
    f"""WITH {PRODUCTS}, {_UPDATES} SELECT product_id, product_name FROM products
    UNION ALL SELECT product_id, product_name FROM updates u WHERE NOT EXISTS (SELECT 1 FROM products p WHERE u.product_id = p.product_id)""",
)
def _(t):
    new = t.read("lineitem").groupBy(F.col("l_partkey").alias("product_id"))
    new = new.agg(F.concat(F.lit("sold "), F.max("l_orderkey").cast("string")).alias("product_name"))
    return sinks.insert_missing(t.products.select("product_id", "product_name"), new, ["product_id"])
