"""Cross-table audits: keys, dependencies, reconciliation, cost gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.quantiles import exact_quantiles
from stockloom.functions.relations import join_same_keys
from stockloom.functions.scalars import count_if, month_label
from stockloom.schemas import GRAIN, SERIES_KEY


def suspicious_flags(sales: DataFrame) -> DataFrame:
    """Mark implausible combinations; nothing is removed."""
    q, p, d = F.col("procured_quantity"), F.col("unit_selling_price"), F.col("total_discount_amount")
    return sales.withColumns(
        {
            "sold_at_zero_price": (q > 0) & (p == 0),
            "priced_without_quantity": (q == 0) & (p > 0),
            "discount_exceeds_value": (d > q * p) & (q > 0) & (p > 0),
        }
    )


def suspicious_counts(sales: DataFrame) -> DataFrame:
    names = ["sold_at_zero_price", "priced_without_quantity", "discount_exceeds_value"]
    return suspicious_flags(sales).agg(*[count_if(F.col(n)).alias(n) for n in names])


def extreme_rows(sales: DataFrame, threshold: float = 5000, n: int = 20) -> DataFrame:
    """The ``n`` highest prices above a threshold."""
    return (
        sales.where(F.col("unit_selling_price") > threshold)
        .select("product_id", "date_", "city_name", "unit_selling_price", "procured_quantity")
        .orderBy(F.desc("unit_selling_price"), "product_id", "date_", "city_name", "procured_quantity")
        .limit(n)
    )


# Columns that identify a repeated transaction.
TRANSACTION_KEY = ["order_id", "product_id", "date_", "city_name", "procured_quantity", "unit_selling_price"]


def duplicate_groups(df: DataFrame, keys: list[str] = TRANSACTION_KEY) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def duplicate_count(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Surplus rows: all rows minus distinct keys (default: whole rows)."""
    counted = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def grain_violations(df: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Rows of the expected grain that are not unique (empty when sound)."""
    return duplicate_groups(df, keys)


def reconcile(sales: DataFrame, demand: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Do the aggregate's totals equal those of the fact table?"""
    other = demand.agg(
        F.struct(F.sum("daily_quantity").alias("qty"), F.sum("daily_revenue").alias("rev")).alias("t")
    ).scalar()
    sums = sales.agg(
        F.sum("procured_quantity").alias("sq"),
        F.sum(F.col("procured_quantity") * F.col("unit_selling_price")).alias("sr"),
    )
    return sums.select(
        F.round("sq", 2).alias("sales_quantity"),
        F.round(other["qty"], 2).alias("demand_quantity"),
        F.round("sr", 2).alias("sales_revenue"),
        F.round(other["rev"], 2).alias("demand_revenue"),
        (F.abs(F.col("sq") - other["qty"]) < tolerance).alias("quantity_match"),
        (F.abs(F.col("sr") - other["rev"]) < tolerance).alias("revenue_match"),
    )


def expectations(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """Evaluate named aggregate expectations in one pass.

    ``checks`` maps a name to (aggregate expression, expected value).
    """
    values = df.agg(*[expr.cast("double").alias(name) for name, (expr, _) in checks.items()])
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(float(expected)).alias("expected"),
            F.col(name).alias("actual"),
            F.coalesce(F.col(name) == F.lit(float(expected)), F.lit(False)).alias("ok"),
        )
        for name, (_, expected) in checks.items()
    ]
    return values.select(F.inline(F.array(*rows)))


def require(results: DataFrame) -> None:
    """Raise when an expectation failed; the list of checks is short by nature."""
    failed = results.where("not ok").collect()
    if failed:
        raise ValueError("; ".join(f"{r['name']}: expected {r['expected']}, got {r['actual']}" for r in failed))


def fd_violations(df: DataFrame, lhs: str, rhs: str) -> DataFrame:
    """Left values with more than one right value."""
    pairs = df.where(F.col(lhs).isNotNull() & F.col(rhs).isNotNull()).groupBy(lhs)
    return pairs.agg(F.countDistinct(rhs).alias("values")).where("values > 1")


def fd_summary(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Number of left values and of violations per tested dependency."""
    parts = []
    for lhs, rhs in pairs:
        grouped = df.where(F.col(lhs).isNotNull()).groupBy(lhs).agg(F.countDistinct(rhs).alias("values"))
        parts.append(
            grouped.agg(
                F.lit(f"{lhs} -> {rhs}").alias("dependency"),
                F.count(F.lit(1)).alias("groups"),
                count_if(F.col("values") > 1).alias("violations"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def verify_order_count(sales: DataFrame, demand: DataFrame) -> DataFrame:
    """Compare stored order counts with exact distinct counts.

    Null keys match null keys, as in grouping; groups of one side only are counted.
    """
    exact = sales.groupBy(*GRAIN).agg(F.countDistinct("order_id").alias("exact"))
    diff = F.col("order_count") - F.col("exact")
    joined = join_same_keys(exact, demand.select(*GRAIN, "order_count"), GRAIN, "full")
    return joined.agg(
        count_if(F.col("exact").isNotNull() & F.col("order_count").isNotNull()).alias("rows_compared"),
        count_if(F.col("order_count").isNull()).alias("only_in_sales"),
        count_if(F.col("exact").isNull()).alias("only_in_demand"),
        count_if(diff != 0).alias("mismatched"),
        count_if(diff > 0).alias("overcounted"),
        count_if(diff < 0).alias("undercounted"),
        F.coalesce(F.max(diff), F.lit(0)).alias("max_overcount"),
        F.coalesce(F.sum("order_count"), F.lit(0)).alias("stored_total"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_total"),
    )


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys only left, only right and in both."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"),
    )


def compare_fields(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Differences per column on the shared keys, where both are filled."""
    a = left.select(key, *[F.col(c).alias(f"l_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"r_{c}") for c in columns])
    counts = a.join(b, key).agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(F.col(f"l_{c}").isNotNull() & F.col(f"r_{c}").isNotNull()).alias("compared"),
                count_if(F.col(f"l_{c}") != F.col(f"r_{c}")).alias("mismatches"),
            ).alias(c)
            for c in columns
        ]
    )
    return counts.select(F.inline(F.array(*columns)))


def unmatched_profile(enriched: DataFrame) -> DataFrame:
    """Sales pattern of every product that the master lacks.

    Cities, months and days of a product are few, so sets of them stay small
    in the partial aggregates; the price median is computed apart.
    """
    rows = enriched.where(F.col("product_name").isNull())
    price, qty = F.col("unit_selling_price"), F.col("procured_quantity")
    cities, months = F.collect_set("city_name"), F.collect_set(month_label("date_"))
    profile = rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(qty).alias("total_qty"),
        F.round(F.sum(qty * price), 2).alias("total_revenue"),
        F.min("date_").alias("first_date"),
        F.max("date_").alias("last_date"),
        F.size(F.collect_set("date_")).cast("bigint").alias("active_days"),
        F.size(cities).cast("bigint").alias("num_cities"),
        F.array_join(F.array_sort(cities), ", ").alias("cities"),
        F.size(months).cast("bigint").alias("num_months"),
        F.array_join(F.array_sort(months), ", ").alias("months"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.round(F.avg(price), 6).alias("avg_price"),
        F.round(F.stddev_samp(price), 6).alias("std_price"),
        F.min(qty).alias("min_qty"),
        F.max(qty).alias("max_qty"),
        F.round(F.avg(qty), 6).alias("avg_qty"),
    )
    medians = exact_quantiles(rows, ["product_id"], "unit_selling_price", {"median_price": 0.5})
    return profile.join(
        medians.withColumn("median_price", F.round("median_price", 8)), "product_id", "left"
    )


def classify_unmatched(profile: DataFrame) -> DataFrame:
    """Strength of evidence that an unmatched id is a real product."""
    rows = F.col("total_rows")
    wide, long_ = F.col("num_cities") >= 2, F.col("num_months") >= 2
    free = (F.col("min_price") == 0) & (F.col("max_price") == 0)
    return profile.withColumn(
        "classification",
        F.when((rows >= 50) & wide & long_, "A_recurring_strong_evidence")
        .when((rows >= 10) & (wide | long_), "A_recurring_moderate_evidence")
        .when(rows >= 5, "B_low_frequency")
        .when((rows >= 2) & ~free, "B_low_frequency")
        .when(free | ((rows < 2) & (F.col("total_qty") == 0)), "C_suspicious_anomalous")
        .otherwise("D_unresolved_single_occurrence"),
    )


def sku_match(sales: DataFrame, raw_master: DataFrame, clean_master: DataFrame) -> DataFrame:
    """How many selling ids the raw and the clean master know."""
    ids = sales.select("product_id").where("product_id is not null").distinct()
    raw = raw_master.select("product_id").distinct().withColumn("r", F.lit(True))
    clean = clean_master.select("product_id").distinct().withColumn("c", F.lit(True))
    return (
        ids.join(raw, "product_id", "left")
        .join(clean, "product_id", "left")
        .agg(
            F.count(F.lit(1)).alias("total_sales_skus"),
            F.count("r").alias("matched_raw_skus"),
            F.count("c").alias("matched_clean_skus"),
            F.count_if(F.col("r").isNull() & F.col("c").isNull()).alias("unmatched_skus"),
        )
    )


def _cost_by_series(sales: DataFrame) -> DataFrame:
    """Missing and known cost rows per series, with the product's known rows.

    The window spans the cities of one product only.
    """
    cost = F.col("total_weighted_landing_price")
    return (
        sales.groupBy(*SERIES_KEY)
        .agg(F.count_if(cost.isNull()).alias("missing"), F.count(cost).alias("known"))
        .withColumn("product_known", F.sum("known").over(Window.partitionBy("product_id")))
        .withColumn("product_missing", F.sum("missing").over(Window.partitionBy("product_id")))
    )


def cost_audit(sales: DataFrame, extreme: float = 10000) -> DataFrame:
    """Gaps and oddities of the unit cost, and whether history can fill them."""
    cost = F.col("total_weighted_landing_price")
    gaps = (
        _cost_by_series(sales)
        .where("product_missing > 0")
        .groupBy("product_id")
        .agg(F.max("product_known").alias("known"))
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("products"),
                F.count_if(F.col("known") > 0).alias("with_history"),
                F.count_if(F.col("known") == 0).alias("without_history"),
            ).alias("t")
        )
        .scalar()
    )
    return sales.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(cost.isNull()).alias("missing_cost"),
        count_if(cost == 0).alias("zero_cost"),
        count_if(cost < 0).alias("negative_cost"),
        count_if(cost > extreme).alias("extreme_cost"),
    ).select(
        "*",
        gaps["products"].alias("products_with_missing_cost"),
        gaps["with_history"].alias("products_with_history"),
        gaps["without_history"].alias("products_without_history"),
    )


def cost_gaps_by(sales: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows without cost per month, city, ..."""
    return (
        sales.where(F.col("total_weighted_landing_price").isNull())
        .groupBy(key.alias(name))
        .agg(F.count(F.lit(1)).alias("missing_rows"))
    )


def cost_recoverability(sales: DataFrame) -> DataFrame:
    """Rows without cost that each recovery tier could fill."""
    m = F.col("missing")

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, m)), F.lit(0))

    return _cost_by_series(sales).agg(
        rows_where(F.col("known") > 0).alias("series_recoverable"),
        rows_where(F.col("known") == 0).alias("series_not_recoverable"),
        rows_where(F.col("product_known") > 0).alias("product_recoverable"),
        rows_where(F.col("product_known") == 0).alias("product_not_recoverable"),
    )


def unresolvable_costs(sales: DataFrame) -> DataFrame:
    """Products that have no cost anywhere, with their affected rows."""
    return (
        _cost_by_series(sales)
        .where("product_known = 0 and product_missing > 0")
        .groupBy("product_id")
        .agg(F.sum("missing").alias("missing_rows"))
    )


def ledger_check(ledger: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Ledger rows where closing stock is not opening + received - sales."""
    expected = F.greatest(
        F.lit(0.0), F.col("opening_stock") + F.col("stock_received") - F.col("sales_quantity")
    )
    return ledger.withColumn("expected_closing", expected).where(
        F.abs(F.col("closing_stock") - F.col("expected_closing")) > tolerance
    )
