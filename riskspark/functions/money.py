"""Currency conversion against a table of dollar rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.constants import FX_TO_USD


def default_rates(spark: SparkSession) -> DataFrame:
    """(currency, usd_rate): the built-in table; pass any frame of this shape to use live rates."""
    return spark.createDataFrame(list(FX_TO_USD.items()), "currency string, usd_rate double")


def currency_key(code: Column) -> Column:
    """Trimmed upper-case code, USD where missing or empty."""
    return F.upper(F.trim(F.coalesce(F.nullif(code, F.lit("")), F.lit("USD"))))


def with_usd_rate(df: DataFrame, rates: DataFrame, code: str, out: str) -> DataFrame:
    """Add the dollar rate of a currency column; unknown codes give 1. One row per currency is broadcast."""
    keyed = rates.select(F.col("currency").alias(f"_{out}_key"), F.col("usd_rate").alias(f"_{out}"))
    return (
        df.join(F.broadcast(keyed), currency_key(F.col(code)) == F.col(f"_{out}_key"), "left")
        .withColumn(out, F.coalesce(F.col(f"_{out}"), F.lit(1.0)))
        .drop(f"_{out}_key", f"_{out}")
    )
