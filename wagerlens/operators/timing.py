"""Phases around kick-off, days and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, PHASES
from ..functions.clock import phase
from ..functions.stats import ratio4
from . import money


def phase_names(spark: SparkSession) -> DataFrame:
    rows = [(i, label, not (low is not None and low >= 0)) for i, (label, low, _) in enumerate(PHASES)]
    return spark.createDataFrame(rows, "position int, phase string, is_pre_match boolean")


def phases(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, money) by phase; every phase has a row of counts, also without legs."""
    placed = legs.withColumn("phase", phase(F.col("minutes_to_kickoff"))).filter(F.col("phase").isNotNull())
    found = placed.groupBy("phase").agg(F.count("*").alias("legs"), F.countDistinct("betslip_id").alias("betslips"))
    return phase_table(found, legs.agg(F.count("*").alias("total"))), money.by_currency(placed, "phase")


def phase_table(found: DataFrame, total: DataFrame) -> DataFrame:
    """All phases in order, with the legs and betslips of those found, and shares of a total (one row)."""
    names = phase_names(found.sparkSession)
    return names.join(found, "phase", "left").crossJoin(F.broadcast(total)).select(
        "position",
        "phase",
        "is_pre_match",
        F.coalesce("legs", F.lit(0)).alias("legs"),
        F.coalesce("betslips", F.lit(0)).alias("betslips"),
        ratio4(F.coalesce("legs", F.lit(0)), F.col("total")).alias("share"),
    )


def daily(betslips: DataFrame, *, operating_share: float = DEFAULTS.operating_share) -> DataFrame:
    """Per day: betslips, legs, whether the day has at least a share of the busiest day's betslips."""
    days = betslips.groupBy(F.to_date("placed_at").alias("day")).agg(F.count("*").alias("betslips"), F.sum("legs").alias("legs"))
    return operating(days, operating_share)


def operating(days: DataFrame, share: float = DEFAULTS.operating_share) -> DataFrame:
    busiest = F.max("betslips").over(Window.partitionBy())  # one row a day
    return days.withColumn("in_operating_period", F.col("betslips") >= busiest * share)


def daily_money(betslips: DataFrame) -> DataFrame:
    return money.by_currency(betslips.withColumn("day", F.to_date("placed_at")), "day")


def monthly(betslips: DataFrame) -> DataFrame:
    months = betslips.groupBy(F.date_format("placed_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("betslips"))
    return shares(months)


def shares(months: DataFrame) -> DataFrame:
    total = F.sum("betslips").over(Window.partitionBy())  # one row a month
    return months.withColumn("share", ratio4(F.col("betslips"), total))
