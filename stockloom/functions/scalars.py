"""Parsing, safe arithmetic and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date spellings: year first or day first, with "-" or "/".
_YEAR_FIRST = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"
_DAY_FIRST = r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def parse_iso_date(c: Column | str) -> Column:
    """Date from year-month-day text only, else null."""
    text = blank_to_null(c)
    return F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text).try_cast("date")


def parse_date(c: Column | str) -> Column:
    """Date from text in any of the accepted spellings, else null.

    The text is brought into year-month-day order and cast, which is far
    cheaper than trying one formatter after the other on each value.
    """
    text = blank_to_null(c)
    year_first = F.when(text.rlike(_YEAR_FIRST), F.translate(text, "/", "-"))
    day_first = F.when(text.rlike(_DAY_FIRST), F.regexp_replace(text, _DAY_FIRST, "$4-$3-$1"))
    return F.coalesce(year_first, day_first).try_cast("date")


def parse_double(c: Column | str) -> Column:
    """Number from text; blank, junk, NaN and infinite values become null."""
    value = blank_to_null(c).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def parse_id(c: Column | str) -> Column:
    """Whole-number id from text, so that "12.0" reads as 12."""
    return parse_double(c).try_cast("bigint")


def parse_int(c: Column | str) -> Column:
    return parse_double(c).try_cast("int")


def pct_change(current: Column, previous: Column, digits: int = 1) -> Column:
    """Percent change against ``previous``; 0 when there is no base."""
    return F.when(previous > 0, F.bround((current - previous) / previous * 100, digits)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole != 0, part / whole * 100), digits)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def day_of_week(c: Column | str) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(col(c))


def is_weekend(c: Column | str) -> Column:
    return (F.weekday(col(c)) >= 5).cast("int")


def month_label(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def product_label(product_id: Column | str, name: Column | str) -> Column:
    """Readable product label, also when the name is missing."""
    text = col(product_id).cast("string")
    named = F.concat(F.trim(col(name)), F.lit(" (Product ID: "), text, F.lit(")"))
    return F.coalesce(
        F.when(blank_to_null(name).isNotNull(), named),
        F.concat(F.lit("Product name is unavailable; Product ID: "), text),
    )


def clip0(c: Column | str) -> Column:
    """Forecasts are never negative."""
    return F.greatest(col(c), F.lit(0.0))


def equals_ignore_case(c: Column | str, value: str | None) -> Column:
    """Filter on a name; None and "ALL" keep everything."""
    if value is None or value.strip().upper() == "ALL":
        return F.lit(True)
    return F.lower(col(c)) == value.strip().lower()


def is_any_of(c: Column | str, values: list | None) -> Column:
    """Filter on a short list of literals; an empty list keeps everything."""
    return col(c).isin(list(values)) if values else F.lit(True)
