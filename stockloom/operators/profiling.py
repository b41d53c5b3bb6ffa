"""Reports on whole tables and files: completeness, ranges, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.quantiles import quantile_values
from stockloom.functions.relations import join_same_keys
from stockloom.functions.scalars import blank_to_null, count_if, parse_date, parse_double
from stockloom.schemas import SALES_COLUMNS, SALES_MEASURES


def _value_counts(raw: DataFrame, products: DataFrame, values: dict[str, Column], by: list[str]) -> DataFrame:
    """Per group: distinct values of each named column, repeats of whole rows, ids checked and matched.

    Rows are turned into narrow (name, value) pairs, counted before the shuffle;
    a whole row stands in them as its 128-bit digest.
    """
    row = F.md5(F.to_json(F.struct(*SALES_COLUMNS), {"ignoreNullFields": "false"}))
    pairs = [F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in (values | {"row": row}).items()]
    counted = (
        raw.select(*by, F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ids = products.select(F.lit("pid").alias("name"), F.col("product_id").cast("string").alias("value")).distinct()
    counted = counted.join(ids.withColumn("known", F.lit(True)), ["name", "value"], "left")
    of = lambda name: F.col("name") == name
    return counted.groupBy(*by).agg(
        *[F.count_if(of(name)).alias(f"distinct_{name}") for name in values],
        F.coalesce(F.sum(F.when(of("row"), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(of("pid"), F.col("n"))), F.lit(0)).alias("ids_checked"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("ids_matched"),
    )


def file_report(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Quality figures per ``source_file`` of a text sales table, with a verdict."""
    rows = raw.withColumns(
        {
            "pid": blank_to_null("product_id"),
            "day": parse_date("date_"),
            "q": parse_double("procured_quantity"),
            "p": parse_double("unit_selling_price"),
            "d": parse_double("total_discount_amount"),
        }
    )
    values = {"orders": F.col("order_id"), "carts": F.col("cart_id"), "customers": F.col("dim_customer_key")}
    values["pid"] = blank_to_null("product_id")
    counts = _value_counts(raw, products, values, ["source_file"])

    def rows_where(condition: Column) -> Column:
        return F.count_if(condition)

    def total(value: Column) -> Column:
        return F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2)

    q, p, d = F.col("q"), F.col("p"), F.col("d")
    sums = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("day").alias("date_min"),
        F.max("day").alias("date_max"),
        rows_where(blank_to_null("date_").isNotNull() & F.col("day").isNull()).alias("date_parse_failures"),
        rows_where(blank_to_null("date_").isNull()).alias("missing_date"),
        rows_where(F.col("pid").isNull()).alias("missing_product_id"),
        rows_where(q.isNull()).alias("missing_quantity"),
        rows_where(p.isNull()).alias("missing_price"),
        rows_where(d.isNull()).alias("missing_discount"),
        rows_where(q < 0).alias("negative_quantity"),
        rows_where(q == 0).alias("zero_quantity"),
        rows_where(p < 0).alias("negative_price"),
        rows_where(p == 0).alias("zero_price"),
        rows_where(d < 0).alias("negative_discount"),
        total(q).alias("quantity_sum"),
        total(q * p).alias("gross_sales_value"),
        total(d).alias("discount_sum"),
        total(q * p - d).alias("net_sales_estimate"),
    )
    renamed = {"distinct_orders": "unique_orders", "distinct_carts": "unique_carts", "distinct_customers": "unique_customers"}
    renamed["distinct_pid"] = "unique_products"
    report = join_same_keys(sums, counts.withColumnsRenamed(renamed), ["source_file"], "left")
    return (
        report.withColumn("ids_unmatched", F.col("ids_checked") - F.col("ids_matched"))
        .withColumn(
            "match_rate", F.round(F.when(F.col("ids_checked") > 0, F.col("ids_matched") / F.col("ids_checked")), 6)
        )
        .withColumn("data_quality_status", verdict())
    )


def verdict(schema_error: Column | None = None) -> Column:
    """First failing rule of a file report decides."""
    rules = [
        (F.col("row_count") == 0, "FAIL - EMPTY"),
        (F.col("date_parse_failures") > 0, "REVIEW - DATE PARSING"),
        (F.col("missing_product_id") > 0, "REVIEW - MISSING PRODUCT IDS"),
        (F.col("missing_quantity") > 0, "REVIEW - MISSING QUANTITY"),
        (F.col("missing_price") > 0, "REVIEW - MISSING PRICE"),
        (F.col("negative_quantity") > 0, "REVIEW - NEGATIVE QUANTITY"),
        (F.col("negative_price") > 0, "REVIEW - NEGATIVE PRICE"),
    ]
    result = F.when(schema_error if schema_error is not None else F.lit(False), F.lit("FAIL - SCHEMA"))
    for condition, label in rules:
        result = result.when(condition, F.lit(label))
    return result.otherwise(F.lit("PASS - BASIC QUALITY"))


def overall_report(reports: DataFrame, expected_files: int) -> DataFrame:
    """One row over all file reports; the match rate is weighted by rows."""
    found = reports.where(F.col("row_count") > 0)
    checked = F.sum("ids_checked")
    return found.agg(
        F.lit(expected_files).cast("bigint").alias("expected_files"),
        F.count(F.lit(1)).alias("files_found"),
        (F.lit(expected_files) - F.count(F.lit(1))).cast("bigint").alias("files_missing"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_found"),
        F.coalesce(F.sum("unique_products"), F.lit(0)).alias("unique_products_sum"),
        F.round(F.when(checked > 0, F.sum("ids_matched") / checked), 6).alias("overall_match_rate"),
        F.min("date_min").alias("overall_date_min"),
        F.max("date_max").alias("overall_date_max"),
        F.round(F.sum("quantity_sum"), 2).alias("total_quantity"),
        F.round(F.sum("gross_sales_value"), 2).alias("gross_sales_value"),
        F.round(F.sum("discount_sum"), 2).alias("total_discount"),
        F.round(F.sum("net_sales_estimate"), 2).alias("net_sales_estimate"),
    )


def dataset_report(raw: DataFrame, products: DataFrame) -> DataFrame:
    """Short report on one text table: PASS, or WARNINGS with the counts."""
    rows = raw.withColumns({"pid": blank_to_null("product_id"), "day": parse_date("date_")})
    sums = rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("day").alias("min_date"),
        F.max("day").alias("max_date"),
        F.count_if(F.col("day").isNull()).alias("missing_dates"),
        F.count_if(F.col("pid").isNull()).alias("missing_product_ids"),
        F.count_if(parse_double("procured_quantity") < 0).alias("negative_quantities"),
        F.count_if(parse_double("unit_selling_price") < 0).alias("negative_prices"),
    )
    counts = _value_counts(raw, products, {"pid": blank_to_null("product_id")}, [])
    share = F.when(F.col("ids_checked") > 0, F.col("ids_matched") / F.col("ids_checked"))
    # Two single rows.
    report = sums.join(counts, F.lit(True)).select(
        "total_rows",
        "duplicate_rows",
        F.col("distinct_pid").alias("unique_products"),
        "min_date",
        "max_date",
        "missing_dates",
        "missing_product_ids",
        "negative_quantities",
        "negative_prices",
        F.round(F.coalesce(share, F.lit(0.0)) * 100, 2).alias("match_rate_pct"),
    )
    warnings = sum(
        (F.col(c) for c in ["missing_dates", "missing_product_ids", "negative_quantities", "negative_prices"]),
        F.lit(0),
    )
    return report.withColumn("status", F.when(warnings > 0, F.lit("WARNINGS")).otherwise(F.lit("PASS")))


def match_rate(df: DataFrame, products: DataFrame, id_column: str = "product_id") -> DataFrame:
    """Share of rows whose trimmed id the master knows; ids are counted first."""
    counted = (
        df.select(blank_to_null(id_column).alias("pid"))
        .where("pid is not null")
        .groupBy("pid")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ids = products.select(F.trim(F.col("product_id").cast("string")).alias("pid")).distinct()
    return counted.join(ids.withColumn("known", F.lit(True)), "pid", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("matched"),
        F.round(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("match_rate"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of every column that has nulls, in one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        counts.unpivot([], df.columns, "column_name", "null_count")
        .where("null_count > 0")
        .orderBy(F.desc("null_count"), "column_name")
    )


def distinct_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct count per column; ``approximate`` uses HyperLogLog sketches."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    counts = df.agg(*[count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "distinct_count")


# Above these a measure counts as extreme.
EXTREMES = {
    "procured_quantity": 1000,
    "unit_selling_price": 10000,
    "total_discount_amount": None,
    "total_weighted_landing_price": 10000,
}
_MEDIAN_OF = ["procured_quantity", "unit_selling_price"]


def numeric_audit(sales: DataFrame) -> DataFrame:
    """Nulls, signs, extremes, range, mean and median of the four measures."""
    aggs = []
    for c in SALES_MEASURES:
        v = F.col(c)
        limit = EXTREMES[c]
        aggs.append(
            F.struct(
                F.lit(c).alias("measure"),
                F.count_if(v.isNull()).alias("null_rows"),
                count_if(v < 0).alias("negative_rows"),
                count_if(v == 0).alias("zero_rows"),
                count_if(v > limit if limit is not None else F.lit(False)).alias("extreme_rows"),
                F.min(v).alias("min_value"),
                F.max(v).alias("max_value"),
                F.round(F.avg(v), 4).alias("avg_value"),
            ).alias(c)
        )
    medians = F.coalesce(
        *[
            F.when(F.col("measure") == c, quantile_values(sales, c, {"median": 0.5})["median"])
            for c in _MEDIAN_OF
        ]
    )
    return (
        sales.agg(*aggs)
        .select(F.inline(F.array(*SALES_MEASURES)))
        .withColumn("median_value", F.round(medians, 4))
    )


def temporal_audit(df: DataFrame, first: str, last: str, column: str = "date_") -> DataFrame:
    """Range and gaps of a text date column against the expected period."""
    text = blank_to_null(column)
    day = text.try_cast("date")
    return df.agg(
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
        F.countDistinct(day).alias("unique_dates"),
        F.count_if(text.isNull()).alias("null_dates"),
        F.count_if(text.isNotNull() & day.isNull()).alias("invalid_dates"),
        count_if(day > F.lit(last).cast("date")).alias("after_range"),
        count_if(day < F.lit(first).cast("date")).alias("before_range"),
    )


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, products, cities and active days per group (month, city, ...)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("product_id").alias("products"),
        F.countDistinct(F.col("city_name")).alias("cities"),
        F.countDistinct("date_").alias("days"),
    )


def external_coverage(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Completeness of a daily external table over the expected period."""
    expected = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.lit(0) + sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))).alias("nulls"),
    )
    return per_key.agg(
        F.sum("n").alias("row_count"),
        expected.cast("bigint").alias("expected_days"),
        F.countDistinct("date_").alias("actual_days"),
        F.min("date_").alias("start_date"),
        F.max("date_").alias("end_date"),
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
        F.sum("nulls").alias("missing_values"),
    ).withColumn(
        "coverage_complete",
        (F.col("actual_days") == F.col("expected_days"))
        & (F.col("start_date") == F.lit(first).cast("date"))
        & (F.col("end_date") == F.lit(last).cast("date")),
    )


def rows_per(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def vocabulary(df: DataFrame, column: str, sentinel: str = "NOT_AVAILABLE") -> DataFrame:
    """Distinct upper-case names, without blanks and the sentinel."""
    word = F.upper(F.trim(F.col(column)))
    return df.select(word.alias("term")).where((F.col("term") != "") & (F.col("term") != sentinel)).distinct()
