"""Row validation of uploaded sale lines: error codes, split, checks, job outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalars import blank_to_null, parse_date, parse_double, parse_id
from stockloom.schemas import SALES_COLUMNS

# Error codes by check, in reporting order.
CHECKS = {
    "date_validation": ["missing_date", "invalid_date"],
    "product_id_validation": ["missing_product_id", "invalid_product_id", "unmatched_product_id"],
    "quantity_validation": ["missing_quantity", "invalid_quantity", "negative_quantity"],
    "price_validation": ["missing_price", "invalid_price", "negative_price"],
    "discount_validation": ["missing_discount", "invalid_discount", "negative_discount"],
    "duplicate_validation": ["duplicate_row"],
}
ERROR_CODES = [code for codes in CHECKS.values() for code in codes]

# short name -> (column, parser, may be negative)
_FIELDS = {
    "date": ("date_", parse_date, True),
    "product_id": ("product_id", parse_id, True),
    "quantity": ("procured_quantity", parse_double, False),
    "price": ("unit_selling_price", parse_double, False),
    "discount": ("total_discount_amount", parse_double, False),
}


def missing_columns(df: DataFrame, required: list[str] = SALES_COLUMNS) -> list[str]:
    """Required columns that the table lacks, sorted (metadata only)."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str] = SALES_COLUMNS) -> DataFrame:
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    return df


def parse_sales(raw: DataFrame) -> DataFrame:
    """Add a typed ``parsed_*`` twin for every checked text column."""
    return raw.withColumns(
        {f"parsed_{short}": parser(column) for short, (column, parser, _) in _FIELDS.items()}
        | {"parsed_cost": parse_double("total_weighted_landing_price")}
    )


def validate_rows(raw: DataFrame, products: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Attach the list of error codes to every text row.

    Exact repeats are counted before anything is shuffled, so a group of copies
    costs one row: the result carries ``copies``, and all copies after the
    first form one row with ``duplicate_row`` among its ``errors``.  ``by``
    keeps extra columns (a job or file id) apart from each other.
    """
    extra = [c for c in (by or []) if c not in SALES_COLUMNS]
    unique = require_columns(raw).groupBy(*extra, *SALES_COLUMNS).agg(F.count(F.lit(1)).alias("_n"))
    known = products.select(F.col("product_id").alias("parsed_product_id")).distinct()
    known = known.withColumn("_known", F.lit(True))
    # The other columns are parsed behind the join, so its shuffle carries the text alone.
    keyed = unique.withColumn("parsed_product_id", parse_id("product_id"))
    rows = parse_sales(keyed.join(known, "parsed_product_id", "left"))

    errors = []
    for short, (column, _, signed) in _FIELDS.items():
        value = F.col(f"parsed_{short}")
        blank = blank_to_null(column).isNull()
        errors.append(F.when(blank, F.lit(f"missing_{short}")))
        errors.append(F.when(~blank & value.isNull(), F.lit(f"invalid_{short}")))
        if short == "product_id":
            errors.append(F.when(value.isNotNull() & F.col("_known").isNull(), F.lit("unmatched_product_id")))
        if not signed:
            errors.append(F.when(value < 0, F.lit(f"negative_{short}")))

    def copy(n, repeated):
        return F.struct(n.cast("bigint").alias("copies"), F.lit(repeated).alias("repeated"))

    first, rest = copy(F.lit(1), False), copy(F.col("_n") - 1, True)
    return (
        rows.withColumn("_errors", F.array_compact(F.array(*errors)))
        .withColumn("_c", F.explode(F.when(F.col("_n") > 1, F.array(first, rest)).otherwise(F.array(first))))
        .withColumn(
            "errors",
            F.when(F.col("_c.repeated"), F.array_append("_errors", F.lit("duplicate_row"))).otherwise(
                F.col("_errors")
            ),
        )
        .withColumn("copies", F.col("_c.copies"))
        .drop("_n", "_known", "_errors", "_c")
    )


def flag_repeats(df: DataFrame, columns: list[str], sequence: str) -> DataFrame:
    """Mark rows whose ``columns`` were seen at a smaller ``sequence``.

    ``sequence`` is a unique, stable row number.  The first row per value group
    is found by aggregation and joined back on the sequence, so a group of many
    copies is never brought together.
    """
    firsts = df.groupBy(*columns).agg(F.min(sequence).alias(sequence)).select(sequence)
    firsts = firsts.withColumn("_first", F.lit(True))
    return df.join(firsts, sequence, "left").withColumn("is_repeat", F.col("_first").isNull()).drop("_first")


def accepted(validated: DataFrame) -> DataFrame:
    """Clean rows in the sales layout."""
    return validated.where(F.size("errors") == 0).select(
        F.col("parsed_date").alias("date_"),
        "city_name",
        "order_id",
        "cart_id",
        "dim_customer_key",
        F.col("parsed_quantity").alias("procured_quantity"),
        F.col("parsed_price").alias("unit_selling_price"),
        F.col("parsed_discount").alias("total_discount_amount"),
        F.col("parsed_product_id").alias("product_id"),
        F.col("parsed_cost").alias("total_weighted_landing_price"),
    )


def rejected(validated: DataFrame) -> DataFrame:
    """Refused rows as they came, with reasons and number of copies."""
    return validated.where(F.size("errors") > 0).select(*SALES_COLUMNS, "errors", "copies")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return accepted(validated), rejected(validated)


def counters(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals and one counter per error code, in one pass."""

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0))

    return validated.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        rows_where(F.size("errors") == 0).alias("valid_rows"),
        *[rows_where(F.array_contains("errors", code)).alias(code) for code in ERROR_CODES],
    )


def error_counts(validated: DataFrame) -> DataFrame:
    """(error_code, row_count) for every code, also the absent ones."""
    return counters(validated).unpivot([], ERROR_CODES, "error_code", "row_count")


def check_summary(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The named checks with PASS, FAIL or WARNING and their numbers."""
    entries = [
        F.struct(
            F.lit(0).alias("check_order"),
            F.lit("required_columns").alias("check_name"),
            F.lit("PASS").alias("status"),
            F.lit("All required columns are present.").alias("details"),
        )
    ]
    for position, (check, codes) in enumerate(CHECKS.items(), start=1):
        found = sum((F.col(code) for code in codes), F.lit(0))
        failure = "WARNING" if check == "duplicate_validation" else "FAIL"
        if check == "date_validation":
            labels = ["Missing dates", "Invalid dates"]
        elif check == "duplicate_validation":
            labels = ["Duplicate rows"]
        else:
            labels = [code.split("_", 1)[0].capitalize() for code in codes]
        parts = [F.concat(F.lit(f"{label}: "), F.col(code).cast("string")) for label, code in zip(labels, codes)]
        entries.append(
            F.struct(
                F.lit(position).alias("check_order"),
                F.lit(check).alias("check_name"),
                F.when(found == 0, F.lit("PASS")).otherwise(F.lit(failure)).alias("status"),
                F.concat_ws("; ", *parts).alias("details"),
            )
        )
    keys = by or []
    return counters(validated, keys).select(*keys, F.inline(F.array(*entries)))


def job_status(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Outcome of an upload: COMPLETED as soon as one row is valid."""
    ok = F.col("valid_rows") > 0
    return counters(validated, by).select(
        *(by or []),
        F.when(ok, F.lit("COMPLETED")).otherwise(F.lit("FAILED")).alias("status"),
        "total_rows",
        F.col("valid_rows").alias("processed_rows"),
        (F.col("total_rows") - F.col("valid_rows")).alias("invalid_rows"),
        F.when(~ok, F.lit("No valid sales rows were found.")).alias("error_summary"),
    )


def unmatched_sample(validated: DataFrame, n: int = 20) -> DataFrame:
    """The smallest ids that the product master lacks."""
    return (
        validated.where(F.array_contains("errors", "unmatched_product_id"))
        .select(F.col("parsed_product_id").alias("product_id"))
        .distinct()
        .orderBy("product_id")
        .limit(n)
    )


def job_history(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Upload jobs, newest first."""
    ordered = jobs.orderBy(F.desc("created_at"), F.desc("job_id"))
    return ordered if limit is None else ordered.limit(limit)


def job_checks(checks: DataFrame, job_id) -> DataFrame:
    """The checks of one job in reporting order."""
    return checks.where(F.col("job_id") == F.lit(job_id)).orderBy("check_order")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    A plain aggregation (combined before the shuffle), not a window, so a key
    with very many versions does not collect in one task.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in others])
