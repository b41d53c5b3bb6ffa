"""Retail views over the star-schema tables.

``Tables`` reads one data directory and offers the retail tables (sales,
products, daily panels, ledgers, messages) that the operators work on.
"""

from __future__ import annotations

from datetime import timedelta
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.operators.features import calendar_grid


class Days(NamedTuple):
    """Dates as text: the calendar's first day, where tuning and validation begin, its last day."""

    first: str
    tune: str
    cut: str
    last: str


class Tables:
    """Lazy access to the tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Sale lines with their order, part and city.

        City comes from customer -> nation -> region; the two small tables are
        joined to the customers first, so the fact table is joined once.
        """
        homes = (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "r_name")
        )
        orders = self.read("orders").join(homes, F.col("o_custkey") == F.col("c_custkey"))
        return (
            self.read("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
            .withColumn("order_date", F.to_date("o_orderdate"))
        )

    @cached_property
    def sales(self) -> DataFrame:
        return self.lines.select(
            F.col("order_date").alias("date_"),
            F.col("r_name").alias("city_name"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_orderkey").alias("cart_id"),
            F.col("o_custkey").alias("dim_customer_key"),
            F.col("l_quantity").alias("procured_quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_selling_price"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("total_discount_amount"),
            F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_returnflag") != "R", F.col("p_retailprice")).alias(
                "total_weighted_landing_price"
            ),
        )

    @cached_property
    def products(self) -> DataFrame:
        """Product master; ids that 50 divides are blank, so their sales are unmatched."""
        return (
            self.read("part")
            .select(
                F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey")).alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.col("p_brand").alias("brand_name"),
                F.col("p_type").alias("l0_category"),
                F.col("p_name").alias("l1_category"),
                F.col("p_size").cast("string").alias("l2_category"),
            )
        )

    @cached_property
    def raw_sales(self) -> DataFrame:
        """The sales as an uploaded text table, with faults of every kind.

        Blanks, junk, negative numbers and four date spellings are derived from
        key remainders; lines with the top discount appear twice.
        """
        part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")

        def whole(c):
            return F.floor(c).cast("bigint").cast("string")

        def faulty(text, blank, junk, junk_text, negative):
            minus = F.concat(F.lit("-"), text)
            return (
                F.when(supp % blank == 0, F.lit(" "))
                .when(supp % junk == 0, F.lit(junk_text))
                .when((line == 1) & (part % negative == 0), minus)
                .otherwise(text)
            )

        day = F.col("order_date")
        text_row = F.struct(
            F.when(part % 53 == 0, F.lit(""))
            .when(part % 59 == 0, F.lit("31-31-2000"))
            .when(line == 2, F.date_format(day, "dd-MM-yyyy"))
            .when(line == 3, F.date_format(day, "yyyy/MM/dd"))
            .when(line == 4, F.date_format(day, "dd/MM/yyyy"))
            .otherwise(F.date_format(day, "yyyy-MM-dd"))
            .alias("date_"),
            F.col("r_name").alias("city_name"),
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_orderkey").cast("string").alias("cart_id"),
            F.col("o_custkey").cast("string").alias("dim_customer_key"),
            faulty(whole(F.col("l_quantity")), 31, 37, "n/a", 97).alias("procured_quantity"),
            faulty(whole(F.col("l_extendedprice") / F.col("l_quantity")), 41, 43, "nan", 89).alias(
                "unit_selling_price"
            ),
            faulty(whole(F.col("l_extendedprice") * F.col("l_discount")), 47, 23, "1,5", 83).alias(
                "total_discount_amount"
            ),
            F.when(part % 61 == 0, F.lit(""))
            .when(part % 67 == 0, F.concat(F.lit("P"), part.cast("string")))
            .when(line == 5, F.concat(part.cast("string"), F.lit(".0")))
            .otherwise(part.cast("string"))
            .alias("product_id"),
            F.when(F.col("l_returnflag") == "R", F.lit(""))
            .otherwise(whole(F.col("p_retailprice")))
            .alias("total_weighted_landing_price"),
        )
        # The text is built once per line, as generator output: what reads it
        # cannot pull the expressions apart again.
        copies = F.when(F.col("l_discount") > 0.095, 2).otherwise(1)
        return self.lines.select(F.explode(F.array_repeat(text_row, copies)).alias("row")).select("row.*")

    @cached_property
    def panel_lines(self) -> DataFrame:
        """Sale lines with the part type as product: few, busy series."""
        return self.lines.select(
            F.col("order_date").alias("date_"),
            F.col("p_type").alias("product_id"),
            F.col("r_name").alias("city_name"),
            F.col("l_quantity").alias("procured_quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_selling_price"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("total_discount_amount"),
            F.col("l_orderkey").alias("order_id"),
        )

    @cached_property
    def days(self) -> Days:
        """First and last day of the orders; the last 30 days are held out, the 30 before tune."""
        first, last = self.read("orders").select(F.to_date("o_orderdate").alias("d")).agg(F.min("d"), F.max("d")).first()
        cut = last - timedelta(days=29)
        return Days(*map(str, (first, cut - timedelta(days=30), cut, last)))

    @cached_property
    def panel(self) -> DataFrame:
        """Daily demand per part type and city, over all days."""
        return self.panel_lines.groupBy("date_", "product_id", "city_name").agg(
            F.sum("procured_quantity").alias("daily_quantity")
        )

    @cached_property
    def event_days(self) -> Days:
        """First and last day of the events; the last six days are held out."""
        first, last = self.read("events").select(F.to_date("ts").alias("d")).agg(F.min("d"), F.max("d")).first()
        cut = last - timedelta(days=5)
        return Days(*map(str, (first, cut, cut, last)))

    @cached_property
    def event_panel(self) -> DataFrame:
        """Daily event value per event type and user bucket: all demand classes occur."""
        user = F.col("user_id")
        bucket = (
            F.when(user < 50, user % 2).when(user < 100, 100 + user % 10).otherwise(1000 + user)
        )
        return (
            self.read("events")
            .groupBy(
                F.to_date("ts").alias("date_"),
                F.col("event_type").alias("product_id"),
                bucket.cast("string").alias("city_name"),
            )
            .agg(F.sum("value").alias("daily_quantity"))
        )

    @cached_property
    def movements(self) -> DataFrame:
        """Daily stock movements of the panel: 40 pieces arrive on the 10th, 20th and 30th."""
        return calendar_grid(self.panel, self.days.first, self.days.last).select(
            "product_id",
            "city_name",
            F.col("date_").alias("snapshot_date"),
            F.when(F.dayofmonth("date_") % 10 == 0, 40.0).otherwise(0.0).alias("stock_received"),
            F.col("daily_quantity").alias("sales_quantity"),
        )
