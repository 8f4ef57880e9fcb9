"""Counts that say how far the other figures carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .money import known


def data_quality(legs: DataFrame) -> DataFrame:
    """One row of counters over legs; a share of nothing is null."""
    return legs.agg(
        F.count("*").alias("legs"),
        F.countDistinct("betslip_id").alias("betslips"),
        F.count_if(F.col("market").contains("{")).alias("placeholder_market_legs"),
        F.count_if(~known(F.col("currency"))).alias("unresolved_currency_legs"),
        F.count_if(F.col("placed_at").isNull()).alias("unparsed_dates"),
        F.count_if("had_key_collision").alias("collision_legs"),
        F.count_if((F.col("bet_type") == "SIMPLE") & (F.col("leg_count") > 1)).alias("simple_with_multiple_legs"),
        F.count_if(F.col("uid_format") == "string").alias("string_uid_legs"),
        F.count_if("is_brand_unit").alias("brand_unit_legs"),
        F.count_if("is_inplay").alias("inplay_legs"),
        F.try_divide(F.count_if("is_inplay"), F.count("*")).alias("inplay_share"),
    )


def book_summary(legs: DataFrame, betslips: DataFrame) -> DataFrame:
    """Per known currency: turnover, ggr, margin (null without turnover) and mean stake over its own betslips."""
    sums = betslips.filter(known(F.col("currency"))).groupBy("currency").agg(
        F.count("*").alias("betslips"), F.sum("turnover").alias("turnover"), F.sum("ggr").alias("ggr")
    )
    t, g = F.col("turnover").cast("double"), F.col("ggr").cast("double")
    return sums.select("currency", "betslips", t.alias("turnover"), g.alias("ggr"), F.try_divide(g, t).alias("margin"), (t / F.col("betslips")).alias("mean_stake"))


def shape(legs: DataFrame) -> DataFrame:
    """What a generated book must resemble: shares of kinds and currencies, legs a Uid, reversals' signature.
    A share of nothing is null."""
    per_uid = legs.groupBy("uid").agg(F.count("*").alias("n")).agg(F.median("n").alias("median_legs_per_uid"))
    kinds = legs.agg(
        F.count("*").alias("legs"),
        F.try_divide(F.count_if(F.col("bet_type") == "SIMPLE"), F.count("*")).alias("simple_share"),
        F.try_divide(F.count_if(F.col("currency") == "EUR"), F.count("currency")).alias("eur_share"),
        F.try_divide(F.count_if(F.col("currency") == "PEN"), F.count("currency")).alias("pen_share"),
        F.count_if(F.col("event_kind") == "reversal").alias("reversals"),
        F.count_if((F.col("event_kind") == "reversal") & (F.col("ggr") != F.col("turnover"))).alias("odd_reversals"),
    )
    return kinds.crossJoin(per_uid)  # one row each
