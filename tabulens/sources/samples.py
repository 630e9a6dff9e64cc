"""Two sample tables with injected gaps, made by Spark from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEED = 42


def _pick(values: list[str], seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def ecommerce(spark: SparkSession, rows: int = 250) -> DataFrame:
    i = F.col("id")
    return spark.range(rows).select(
        F.format_string("ORD-%04d", i + 1000).alias("Order_ID"),
        F.timestamp_add("DAY", i.cast("int"), F.to_timestamp(F.lit("2024-01-01"))).alias("Order_Date"),
        F.when(i % 31 != 7, F.floor(F.rand(SEED) * 52 + 18).cast("double")).alias("Customer_Age"),
        _pick(["Electronics", "Clothing", "Home", "Books", "Sports", "Beauty"], SEED + 1).alias("Category"),
        F.round(20 - 150 * F.ln(1 - F.rand(SEED + 2)), 2).alias("Sales_Amount"),
        F.floor(F.rand(SEED + 3) * 9 + 1).alias("Quantity"),
        F.when(i % 50 != 11, F.floor(F.rand(SEED + 4) * 4) * 0.05).alias("Discount_Pct"),
        _pick(["North", "South", "East", "West", "Central"], SEED + 5).alias("Region"),
        _pick(["Card", "Cash", "Transfer", "Wallet"], SEED + 6).alias("Payment_Method"),
        (F.rand(SEED + 7) < 0.1).alias("Is_Returned"))


def employee(spark: SparkSession, rows: int = 250) -> DataFrame:
    i = F.col("id")
    years = F.floor(F.rand(SEED + 1) * 25)
    return spark.range(rows).select(
        F.format_string("EMP-%04d", i + 1).alias("Employee_ID"),
        _pick(["Sales", "Engineering", "Marketing", "Finance", "Support", "Operations"], SEED).alias("Department"),
        years.alias("Experience_Years"),
        F.when(i % 42 != 3, F.round(40_000 + 2_500 * years + 8_000 * F.randn(SEED + 2), 2)).alias("Salary"),
        F.floor(F.rand(SEED + 3) * 5 + 1).alias("Performance_Score"),
        _pick(["High School", "Bachelor", "Master", "PhD"], SEED + 4).alias("Education_Level"),
        (F.rand(SEED + 5) < 0.4).alias("Remote_Work"),
        F.floor(F.rand(SEED + 6) * 30).alias("Projects_Completed"))
