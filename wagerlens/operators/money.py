"""The only place where money is summed: within a currency, never across."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(currency: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(currency)).isin("", "nan"), F.lit(False))


def by_currency(rows: DataFrame, *keys: str, value: str = "turnover") -> DataFrame:
    """Flat: keys, currency (null for unresolved), n_rows, amount."""
    currency = F.when(known(F.col("currency")), F.col("currency")).alias("currency")
    return rows.groupBy(*keys, currency).agg(F.count("*").alias("n_rows"), F.sum(value).alias("amount"))


def block(rows: DataFrame, *keys: str, value: str = "turnover") -> DataFrame:
    """Nested: keys, money = {by_currency: map, unresolved_rows, unresolved_units}."""
    flat = by_currency(rows, *keys, value=value)
    pairs = F.array_sort(F.collect_list(F.when(F.col("currency").isNotNull(), F.struct("currency", F.col("amount").cast("decimal(18,2)")))))
    unknown = F.col("currency").isNull()
    money = F.struct(
        F.map_from_entries(pairs).alias("by_currency"),
        F.coalesce(F.sum(F.when(unknown, F.col("n_rows"))), F.lit(0)).alias("unresolved_rows"),
        F.coalesce(F.sum(F.when(unknown, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("unresolved_units"),
    ).alias("money")
    return flat.groupBy(*keys).agg(money) if keys else flat.agg(money)


def inflation(legs: DataFrame, betslips: DataFrame) -> DataFrame:
    """Per currency with a positive total: stakes summed over legs, over betslips, and their ratio."""
    over_legs = legs.filter(known(F.col("currency"))).groupBy("currency").agg(F.sum("turnover").alias("leg_turnover"))
    over_slips = betslips.filter(known(F.col("currency"))).groupBy("currency").agg(F.sum("turnover").alias("betslip_turnover"))
    return ratio(over_legs, over_slips)


def ratio(over_legs: DataFrame, over_slips: DataFrame) -> DataFrame:
    return (
        over_legs.join(over_slips, "currency")
        .filter("betslip_turnover > 0")
        .withColumn("inflation", F.col("leg_turnover").cast("double") / F.col("betslip_turnover").cast("double"))
    )
