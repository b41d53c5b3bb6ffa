"""Market quotes against own cost baselines, and quote extraction from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalars import equals_ignore_case

# Category of each quoted commodity, and of all others.
CATEGORY_OF = {
    "Rice": "Grains & Pulses",
    "Wheat": "Grains & Pulses",
    "Atta (Wheat)": "Grains & Pulses",
    "Gram Dal": "Grains & Pulses",
    "Tur/Arhar Dal": "Grains & Pulses",
    "Urad Dal": "Grains & Pulses",
    "Moong Dal": "Grains & Pulses",
    "Masoor Dal": "Grains & Pulses",
    "Broken Rice": "Grains & Pulses",
    "Groundnut Oil (Packed)": "Edible Oils",
    "Mustard Oil (Packed)": "Edible Oils",
    "Vanaspati (Packed)": "Edible Oils",
    "Soya Oil (Packed)": "Edible Oils",
    "Sunflower Oil (Packed)": "Edible Oils",
    "Palm Oil (Packed)": "Edible Oils",
    "Potato": "Vegetables",
    "Onion": "Vegetables",
    "Tomato": "Vegetables",
    "Sugar": "Daily Essentials",
    "Gur": "Daily Essentials",
    "Milk @": "Daily Essentials",
    "Tea Loose": "Daily Essentials",
    "Salt Pack (Iodised)": "Daily Essentials",
    "Bajra (whole)": "Additional Millets",
    "Jowar (whole)": "Additional Millets",
    "Ragi": "Additional Millets",
    "Maize": "Additional Millets",
    "Barley": "Additional Millets",
}
OTHER_CATEGORY = "Grains & Essentials"
# Patterns of the price page.
NAME_PATTERN = r'lblCommName">([^<]+)<'
PRICE_PATTERN = r'lblPrices">([0-9.]+)<'
DATE_PATTERN = r'id="lblDate1">([^<]+)<'
UNIT = "₹ / Kg"


def price_divergence(skus: DataFrame, quotes: DataFrame) -> DataFrame:
    """Market price against the cost baseline of each product.

    A product whose commodity has no quote is compared with its baseline plus
    ten percent, and says so.
    """
    market = quotes.groupBy(F.lower("commodity").alias("_c")).agg(F.max("price").alias("_quote"))
    baseline = F.col("baseline_price")
    live = F.coalesce("_quote", baseline * 1.10)
    return (
        skus.join(market, F.lower(skus["commodity"]) == F.col("_c"), "left")
        .withColumns(
            {
                "live_market_price": live,
                "price_source": F.when(F.col("_quote").isNotNull(), "quote").otherwise("baseline_estimate"),
                "divergence_pct": F.bround((live - baseline) / baseline * 100, 1),
            }
        )
        .drop("_c", "_quote")
    )


# Lower limit of the divergence, action, share of the standard
# stock to hold, and risk level; the dip rule applies at or below -10.
SURGE = [
    (25.0, "TRIM_STOCK", 0.80, "HIGH_INFLATION"),
    (12.0, "MODERATE_REDUCTION", 0.90, "MODERATE_SURGE"),
]
DIP = (-10.0, "BULK_PROCURE", 1.25, "OPPORTUNITY_DIP")
STEADY = ("MAINTAIN_BASELINE", 1.00, "STABLE_MARKET")


def holding_decision(df: DataFrame) -> DataFrame:
    """How much stock to hold at the present price."""
    d = F.col("divergence_pct")

    def pick(index: int) -> Column:
        value = F.when(d >= SURGE[0][0], F.lit(SURGE[0][index]))
        for rule in SURGE[1:]:
            value = value.when(d >= rule[0], F.lit(rule[index]))
        return value.when(d <= DIP[0], F.lit(DIP[index])).otherwise(F.lit(STEADY[index - 1]))

    quantity = F.bround(F.col("standard_holding_qty") * pick(2), 0).cast("bigint")
    return df.withColumns(
        {
            "action": pick(1),
            "risk_level": pick(3),
            "recommended_holding_qty": quantity,
            "quantity_delta": quantity - F.col("standard_holding_qty"),
        }
    )


def market_kpis(decisions: DataFrame, category: str | None = None) -> DataFrame:
    """Surges, dips and steady prices, optionally of one category."""
    rows = decisions.where(equals_ignore_case("category", category)) if category else decisions
    d = F.col("divergence_pct")
    return rows.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(d >= 15).alias("surges"),
        F.count_if(d <= -10).alias("dips"),
        F.count_if((d < 15) & (d > -10)).alias("stable"),
    )


def category_of(c: Column | str) -> Column:
    pairs = [F.lit(x) for pair in CATEGORY_OF.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col(c) if isinstance(c, str) else c], F.lit(OTHER_CATEGORY))


def extract_quotes(
    pages: DataFrame,
    html: str = "html",
    key: str = "page_id",
    name_pattern: str = NAME_PATTERN,
    price_pattern: str = PRICE_PATTERN,
    date_pattern: str = DATE_PATTERN,
) -> DataFrame:
    """Name/price pairs of each page; the first price of a name counts.

    Names and prices are found independently and paired by position, up to the
    shorter list.
    """
    text = F.col(html)
    names = F.regexp_extract_all(text, F.lit(name_pattern), F.lit(1))
    prices = F.regexp_extract_all(text, F.lit(price_pattern), F.lit(1))
    lists = pages.select(key, F.regexp_extract(text, date_pattern, 1).alias("_date"), names.alias("_n"), prices.alias("_p"))
    shorter = F.least(F.size("_n"), F.size("_p"))
    pairs = F.arrays_zip(F.slice("_n", 1, shorter).alias("name"), F.slice("_p", 1, shorter).alias("price"))
    return (
        lists.where(shorter > 0)
        .select(key, "_date", F.posexplode(pairs).alias("_pos", "_pair"))
        .groupBy(key, F.trim("_pair.name").alias("commodity"))
        .agg(F.min_by(F.col("_pair.price"), F.col("_pos")).alias("price_text"), F.max("_date").alias("_date"))
        .select(
            key,
            "commodity",
            "price_text",
            F.col("price_text").try_cast("double").alias("price_inr_per_kg"),
            category_of("commodity").alias("category"),
            F.lit(UNIT).alias("unit"),
            F.nullif(F.trim("_date"), F.lit("")).alias("as_on_date"),
        )
    )
