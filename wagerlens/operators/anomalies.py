"""Detectors: turnover spikes, repeat backing, abnormal exposure, same-second clusters, and their alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.lookups import bitmap, hashes, several, sieved
from ..functions.ranks import quantile as quantile_of
from ..sources.staged import written
from .legs import ORDER, enrich, second_of
from .prices import GROUP, attach_value


def turnover_spikes(betslips: DataFrame, *, share: float = DEFAULTS.operating_share, least_days: int = DEFAULTS.spike_days, multiplier: float = DEFAULTS.spike_multiplier) -> DataFrame:
    """Days of a currency whose turnover is over median + multiplier x MAD of its operating days.

    Median and MAD are exact order statistics of cents, found by histograms.
    """
    return spikes_of_days(days_of(betslips), share=share, least_days=least_days, multiplier=multiplier)


def days_of(betslips: DataFrame) -> DataFrame:
    """Turnover and betslips by currency and day."""
    known = betslips.filter(F.col("currency").isNotNull() & F.col("placed_at").isNotNull())
    return known.groupBy("currency", F.to_date("placed_at").alias("day")).agg(F.sum("turnover").alias("turnover"), F.count("*").alias("betslips"))


def spikes_of_days(days: DataFrame, *, share: float = DEFAULTS.operating_share, least_days: int = DEFAULTS.spike_days, multiplier: float = DEFAULTS.spike_multiplier) -> DataFrame:
    """turnover_spikes from days_of."""
    of_currency = Window.partitionBy("currency")  # one row a day
    days = days.withColumn("busiest", F.max("betslips").over(of_currency)).filter(F.col("betslips") >= F.col("busiest") * share)
    value = F.col("turnover").cast("double")
    days = written(days.withColumn("cents", (F.col("turnover") * 100).cast("long")))
    # twice the median, and twice the distances from it, are whole cents
    middle = quantile_of(days, "cents", 0.5, ["currency"]).filter(F.col("n") >= least_days).select("currency", (F.col("low") + F.col("high")).alias("twice"))
    days = written(days.join(middle, "currency").withColumn("apart", F.abs(2 * F.col("cents") - F.col("twice"))))
    spread = quantile_of(days, "apart", 0.5, ["currency"]).select("currency", ((F.col("low") + F.col("high")) / F.lit(400.0)).alias("mad")).filter("mad > 0")
    days = days.withColumn("median", F.col("twice") / F.lit(200.0)).join(spread, "currency").withColumn("threshold", F.col("median") + multiplier * F.col("mad"))
    return days.filter(value > F.col("threshold")).select(
        "currency", "day", value.alias("turnover"), "betslips", "median", "mad", "threshold", F.round(F.try_divide(value, F.col("threshold")), 3).alias("excess_ratio")
    )


#: What repeat backing is told apart by: one Uid on one selection.
BACKED = ("uid", *GROUP)


def _complete() -> Column:
    return reduce(lambda a, c: a & F.col(c).isNotNull(), BACKED[1:], F.col(BACKED[0]).isNotNull())


def may_repeat(legs: DataFrame, *, least: int = DEFAULTS.repeat_betslips) -> DataFrame:
    """Of legs with their row facts (written: they are read several times), those that repeat_backing may need, enriched and priced.

    A betslip has a leg at least, so a Uid and selection of fewer than `least` legs are left out before anything is dealt
    whole: hashes are counted first, and only rows of the frequent ones follow, with the counts of their seconds and the last
    leg of their price groups.  Rows that only share a hash come along and are told apart by repeat_backing.
    """
    pair, group, second = [*BACKED], [*GROUP], [second_of()]
    known = legs.filter(_complete())
    likely = written(sieved(known, pair, bitmap(several(known, pair, least))))
    same_second = sieved(legs.select("uid", "placed_at", "bet_type"), second, bitmap(hashes(likely, second)))
    same_group = sieved(known, group, bitmap(hashes(likely, group)))
    return attach_value(enrich(likely, among=same_second), among=same_group)


def repeat_backing(priced: DataFrame, *, least: int = DEFAULTS.repeat_betslips) -> DataFrame:
    """One Uid on one selection over at least `least` betslips; stakes count once a betslip and are null
    where currencies mix."""
    key = [*BACKED]
    rows = priced.filter(_complete())
    order = F.struct(*ORDER)
    slips = rows.groupBy(*key, "betslip_id").agg(
        F.count("*").alias("n"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.min_by("price", order).alias("first_price"),
        F.max_by("price", order).alias("last_price"),
        F.min_by("turnover", order).alias("stake"),
        F.min_by("fixture", order).alias("fixture"),
        F.min_by("currency", order).alias("currency"),
        F.bool_or("had_key_collision").alias("collided"),
        F.sum("value_winsorised").alias("value_sum"),
        F.count("value_winsorised").alias("value_n"),
    )
    groups = slips.groupBy(*key).agg(
        F.count("*").alias("betslips"),
        F.sum("n").alias("legs"),
        F.min_by("fixture", "first").alias("fixture"),
        F.min_by("currency", "first").alias("currency"),
        F.countDistinct("currency").alias("currencies"),
        F.min_by("first_price", "first").cast("double").alias("first_price"),
        F.max_by("last_price", "last").cast("double").alias("last_price"),
        F.min("first.placed_at").alias("first_seen"),
        F.max("last.placed_at").alias("last_seen"),
        F.bool_or("collided").alias("includes_key_collision"),
        F.sum("stake").cast("double").alias("stake"),
        (F.sum("value_sum") / F.nullif(F.sum("value_n"), F.lit(0)) / 1e6).alias("mean_price_value"),
    )
    single = F.col("currencies") <= 1
    return groups.filter(F.col("betslips") >= least).select(
        *key, "betslips", "legs", "fixture",
        F.when(single, F.col("currency")).alias("currency"), "first_price", "last_price",
        F.when(single, F.col("stake")).alias("stake"), "mean_price_value", "includes_key_collision",
        ((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(60_000_000.0)).alias("span_minutes"),
    )


def abnormal_exposure(
    legs: DataFrame, *, quantile: float = DEFAULTS.exposure_quantile, share: float = DEFAULTS.exposure_share,
    fixture_legs: int = DEFAULTS.exposure_fixture_legs, fixtures: int = DEFAULTS.exposure_fixtures, selection_legs: int = DEFAULTS.exposure_selection_legs,
) -> DataFrame:
    """Fixtures of a currency's highest turnovers of which one selection holds at least `share`; unnamed where legs are."""
    known = legs.filter(F.col("currency").isNotNull() & F.col("match_id").isNotNull())
    per_fixture = known.groupBy("currency", "match_id").agg(
        F.sum("turnover").alias("fixture_turnover"), F.count("*").alias("n"), (F.min_by("fixture", F.struct(*ORDER)) if "fixture" in legs.columns else F.lit(None).cast("string")).alias("fixture")
    ).filter(F.col("n") >= fixture_legs)
    per_fixture = written(per_fixture.withColumn("cents", (F.col("fixture_turnover") * 100).cast("long")))
    cut = quantile_of(per_fixture, "cents", quantile, ["currency"], scale=100.0).filter(F.col("n") >= fixtures).select("currency", F.col("result").alias("cutoff"))
    chosen = per_fixture.join(cut, "currency").filter((F.col("fixture_turnover").cast("double") >= F.col("cutoff")) & (F.col("fixture_turnover") > 0))
    complete = known.filter(F.col("market_normalised").isNotNull() & F.col("player").isNotNull() & F.col("selection").isNotNull())
    by_selection = complete.join(chosen.select("currency", "match_id"), ["currency", "match_id"], "left_semi").groupBy(
        "currency", "match_id", "market_normalised", "player", "selection"
    ).agg(F.sum("turnover").alias("selection_turnover"), F.count("*").alias("legs"), F.countDistinct("uid").alias("distinct_uids"))
    facts = F.struct("selection_turnover", "legs", "distinct_uids", "market_normalised", "player", "selection")
    best = F.struct(-F.col("selection_turnover"), F.col("market_normalised"), F.col("player"), F.col("selection"))
    top = by_selection.groupBy("currency", "match_id").agg(F.min_by(facts, best).alias("top")).select("currency", "match_id", "top.*")
    part = F.col("selection_turnover").cast("double") / F.col("fixture_turnover").cast("double")
    return top.join(chosen, ["currency", "match_id"]).filter((part >= share) & (F.col("legs") >= selection_legs)).select(
        "match_id", "fixture", "currency", F.col("fixture_turnover").cast("double").alias("fixture_turnover"),
        F.col("market_normalised").alias("market"), "selection", F.col("player").alias("player_label"),
        F.col("selection_turnover").cast("double").alias("selection_turnover"), F.round(part, 4).alias("share"), "legs", "distinct_uids",
        (F.col("distinct_uids") < 2).alias("single_actor"),
    )


def same_second_clusters(legs: DataFrame) -> DataFrame:
    """Single bets of one Uid at one time, by (uid, placed_at); stake and currency null where currencies mix."""
    single = F.countDistinct("currency") <= 1
    grouped = legs.filter("had_key_collision").groupBy("uid", "placed_at").agg(
        F.countDistinct("betslip_id").alias("cluster_size"),
        F.count("*").alias("legs"),
        F.countDistinct("match_id").alias("fixtures"),
        F.countDistinct("market_normalised").alias("markets"),
        F.min_by("region", F.struct(*ORDER)).alias("region"),
        F.min_by("uid_format", F.struct(*ORDER)).alias("uid_format"),
        F.when(single, F.min("currency")).alias("currency"),
        F.when(single, F.sum("turnover")).cast("double").alias("stake"),
    )
    return grouped


def clustered_seconds(legs: DataFrame) -> DataFrame:
    """(uid, placed_at) of same_second_clusters, of legs that are not enriched."""
    times = legs.groupBy("uid", "placed_at").agg(F.count("*").alias("n"), F.count_if(F.col("bet_type") == "SIMPLE").alias("single"))
    times = times.withColumn("in_second", F.sum("n").over(Window.partitionBy(second_of())))  # a row a time
    return times.filter((F.col("single") > 0) & (F.col("in_second") > 1)).select("uid", "placed_at")


#: Severities of the alert model, most urgent first.
SEVERITIES = ("critical", "serious", "warning", "signature")


def alerts(flagged_windows: DataFrame, exposure: DataFrame, spikes: DataFrame, clusters: DataFrame, backing: DataFrame) -> DataFrame:
    """All findings as (section, severity, ref), to be counted and listed by urgency."""
    parts = [
        flagged_windows.select(F.lit("sharp").alias("section"), F.lit("critical").alias("severity"), F.col("uid").alias("ref")),
        exposure.select(F.lit("exposure"), F.lit("serious"), F.concat_ws("|", "match_id", "currency")),
        spikes.select(F.lit("spikes"), F.lit("warning"), F.concat_ws("|", "currency", F.col("day").cast("string"))),
        clusters.select(F.lit("clusters"), F.lit("signature"), F.concat_ws("|", "uid", F.date_format("placed_at", "yyyy-MM-dd HH:mm:ss"))),
        backing.select(F.lit("repeat_backing"), F.lit("signature"), F.concat_ws("|", "uid", "match_id", "market_normalised", "player", "selection")),
    ]
    return reduce(DataFrame.union, parts)


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("section", "severity").agg(F.count("*").alias("alerts"))
