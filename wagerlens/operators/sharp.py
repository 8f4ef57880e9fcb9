"""Uid windows that beat the market's later price more often than the book's own rate explains.

Units are a Uid's different priced selections; a window is all activity of one Uid.  The test is exact,
one-sided and controlled for false discoveries over the family of all flag-eligible windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.ranks import running
from ..functions.stats import binomial_upper_tail, floor_div, wilson_lower
from ..sources.staged import written
from .legs import ORDER, second_of
from .prices import GROUP


def scoring_units(priced: DataFrame) -> DataFrame:
    """Per Uid and price group: legs, value_sum, mean_value, stake, currency, beat (mean > 0, strictly)."""
    scope = priced.filter(F.col("value_eligible") & ~F.col("reference_is_own_bet"))
    units = scope.groupBy("uid", *GROUP).agg(
        F.count("*").alias("legs"),
        F.sum("value_winsorised").alias("value_sum"),
        (F.sum("value_winsorised") / F.count("*") / 1e6).alias("mean_value"),
        F.sum("turnover").alias("stake"),
        F.min_by("currency", F.struct(F.col("currency").isNull(), *ORDER)).alias("currency"),
        F.min("placed_at").alias("placed_at"),
        (F.sum("value_winsorised") > 0).alias("beat"),
    )
    # the mean in whole billionths, so that sums over units don't depend on their order
    return units.withColumn("mean_nano", floor_div(2000 * F.col("value_sum") + F.col("legs"), 2 * F.col("legs")))


def unit_sums(units: DataFrame) -> DataFrame:
    """Units by Uid and currency: n, beats, nano (the sum of means), stake and the stake-weighted sum of means.  What windows
    and the book's own rate are made of."""
    return units.groupBy("uid", "currency").agg(
        F.count("*").alias("n"),
        F.count_if("beat").alias("beats"),
        F.sum("mean_nano").alias("nano"),
        F.sum("stake").alias("stake"),
        F.sum(F.col("stake").cast("decimal(18,2)") * F.col("mean_nano").cast("decimal(12,0)")).alias("weighted"),
    )


def added(sums: DataFrame) -> DataFrame:
    """unit_sums of a book from those of its slices."""
    return sums.groupBy("uid", "currency").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("uid", "currency")])


def dominant_currency(sums: DataFrame) -> DataFrame:
    """Per Uid: its most frequent currency (ties: the smallest), the stake-weighted value within it (in
    millionths per unit of stake), and whether it has several.  Of units, or of their unit_sums."""
    per = (sums if "weighted" in sums.columns else unit_sums(sums)).filter(F.col("currency").isNotNull())
    facts = F.struct("currency", "stake", "weighted")
    return per.groupBy("uid").agg(
        F.min_by(facts, F.struct(-F.col("n"), F.col("currency"))).alias("top"),
        (F.count("*") > 1).alias("multi_currency"),
    ).select(
        "uid",
        F.col("top.currency").alias("dominant_currency"),
        F.when(F.col("top.stake") > 0, F.col("top.weighted").cast("double") / F.col("top.stake").cast("double") / 1e9).alias("stake_weighted_price_value"),
        "multi_currency",
    )


def uid_context(legs: DataFrame, *, late_minutes: int = DEFAULTS.late_minutes) -> DataFrame:
    """Per Uid, in one aggregation: betslips, legs, span, shares, region, markets; and its top market."""
    minutes = F.col("minutes_to_kickoff")
    grouped = legs.groupBy("uid").agg(
        F.countDistinct("betslip_id").alias("betslips"),
        F.count("*").alias("legs"),
        F.min("placed_at").alias("first_seen"),
        F.max("placed_at").alias("last_seen"),
        F.min_by("region", F.struct(*ORDER)).alias("region"),
        F.min_by("uid_format", F.struct(*ORDER)).alias("uid_format"),
        F.countDistinct("market_normalised").alias("distinct_markets"),
        F.bool_or("had_key_collision").alias("has_same_second_clusters"),
        (F.count_if((minutes >= -late_minutes) & (minutes <= 0)) / F.count("*")).alias("late_share"),
        (F.count_if("is_inplay") / F.count("*")).alias("inplay_share"),
        (F.count_if(F.col("bet_type") == "SIMPLE") / F.count("*")).alias("simple_share"),
    )
    grouped = grouped.withColumn("span_days", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(86_400_000_000.0))
    market = legs.groupBy("uid", "market_normalised").agg(F.count("*").alias("n"))
    market = market.groupBy("uid").agg(F.min_by("market_normalised", F.struct(-F.col("n"), F.col("market_normalised"))).alias("top_market"))
    return grouped.join(market, "uid", "left")


def betslips_by_uid(legs: DataFrame) -> DataFrame:
    """Per Uid, its betslips, of legs that have no betslip_id: a single bet is one, the other legs of a second are one."""
    single = F.col("bet_type") == "SIMPLE"
    singles = legs.filter(single).groupBy("uid").agg(F.count("*").alias("n"))
    others = legs.filter(~F.coalesce(single, F.lit(False))).select("uid", second_of().alias("second")).distinct().groupBy("uid").agg(F.count("*").alias("n"))
    return singles.unionByName(others).groupBy("uid").agg(F.sum("n").alias("betslips"))


def _per_uid(sums: DataFrame) -> DataFrame:
    per_uid = sums.groupBy("uid").agg(
        F.sum("n").alias("priced_units"), F.sum("beats").alias("beats"), (F.sum("nano") / F.sum("n") / 1e9).alias("mean_price_value")
    )
    return per_uid.join(dominant_currency(sums), "uid", "left")


def windows(priced: DataFrame) -> DataFrame:
    """Per Uid with priced units: priced_units, beats, mean_price_value, fixtures, currency and context."""
    units = scoring_units(priced)
    rows = _per_uid(unit_sums(units)).join(units.groupBy("uid").agg(F.countDistinct("match_id").alias("distinct_fixtures")), "uid")
    names = ("priced_units", "beats", "mean_price_value", "distinct_fixtures", "dominant_currency", "stake_weighted_price_value", "multi_currency")
    return rows.select("uid", *names).join(uid_context(priced), "uid")


def percentile_rank(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of ties over n, times 100, one decimal.  Ranks different values, not rows, within ranges."""
    kinds = running(written(rows.groupBy(value).agg(F.count("*").alias("peers"))), value, ["peers"], [])
    kinds = kinds.select(F.col(value).alias("of_value"), ((F.col("upto_peers") - (F.col("peers") - 1) / 2) / F.col("all_peers")).alias("part"))
    return rows.join(kinds, F.col(value).eqNullSafe(F.col("of_value"))).withColumn(out, F.round(F.col("part") * 100, 1)).drop("of_value", "part")


def benjamini_hochberg(rows: DataFrame, p: str, q: float, out: str = "fdr_pass") -> DataFrame:
    """Step-up mask over one family: passes where p is at most the largest p_(i) <= q i / n.

    The family is ranked whole: distinct p-values with their counts, within ranges that add what the ranges before have.
    """
    kinds = running(written(rows.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("peers"))), p, ["peers"], [])
    limit = kinds.agg(F.max(F.when(F.col(p) <= q * F.col("upto_peers") / F.col("all_peers"), F.col(p))).alias("p_limit"))
    return rows.crossJoin(F.broadcast(limit)).withColumn(out, F.coalesce(F.col(p) <= F.col("p_limit"), F.lit(False))).drop("p_limit")


def score(priced: DataFrame, *, least_betslips: int = DEFAULTS.score_betslips, least_units: int = DEFAULTS.flag_units, q: float = DEFAULTS.fdr_q) -> DataFrame:
    """All scored windows with beat_rate, wilson_lb, score, p_value, fdr_pass and flagged."""
    baseline = scoring_units(priced).agg(F.try_divide(F.count_if("beat"), F.count("*")).alias("baseline"))
    return _scored(windows(priced), baseline, least_betslips, least_units, q)


def score_sums(sums: DataFrame, betslips: DataFrame, *, least_betslips: int = DEFAULTS.score_betslips, least_units: int = DEFAULTS.flag_units, q: float = DEFAULTS.fdr_q) -> DataFrame:
    """score from unit_sums (written) and each Uid's betslips, without the windows' context: no leg is read again."""
    baseline = sums.agg(F.try_divide(F.coalesce(F.sum("beats"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("baseline"))
    return _scored(_per_uid(sums).join(betslips, "uid"), baseline, least_betslips, least_units, q)


def _scored(rows: DataFrame, baseline: DataFrame, least_betslips: int, least_units: int, q: float) -> DataFrame:
    rows = rows.filter(F.col("betslips") >= least_betslips)
    rows = rows.withColumn("beat_rate", F.col("beats") / F.col("priced_units"))
    rows = rows.withColumn("wilson_lb", F.round(wilson_lower(F.col("beats"), F.col("priced_units"), DEFAULTS.wilson_z), 12))
    rows = percentile_rank(rows, "wilson_lb", "score")
    rows = rows.crossJoin(F.broadcast(baseline))  # one row
    tested = F.col("priced_units") >= least_units
    # rounded, so that windows alike in counts tie however their sums were ordered
    rows = rows.withColumn("p_value", F.when(tested, F.round(binomial_upper_tail("beats", "priced_units", "baseline"), 12)))
    rows = benjamini_hochberg(rows, "p_value", q)
    flagged = F.col("fdr_pass") & F.coalesce(F.col("stake_weighted_price_value") > 0, F.lit(False))
    return rows.withColumn("flagged", flagged)


def report(priced: DataFrame, scored: DataFrame, *, least_units: int = DEFAULTS.flag_units, q: float = DEFAULTS.fdr_q) -> DataFrame:
    """One row: windows scored, eligible, flagged, what plainer rules would have flagged, and the rate of all units that beat."""
    counts = scored.agg(
        F.count("*").alias("scored_windows"),
        F.count_if(F.col("priced_units") >= least_units).alias("flag_eligible_windows"),
        F.count_if("flagged").alias("flagged_windows"),
        F.count_if(F.col("p_value") <= 0.05).alias("flags_under_raw_alpha"),
        F.bround(F.count("*") * 0.10).cast("long").alias("flags_under_top_decile"),
        F.count_if("multi_currency").alias("multi_currency_windows"),
        F.median("priced_units").alias("median_units_per_window"),
        (q * F.count_if("flagged")).alias("expected_false_discoveries"),
    )
    units = scoring_units(priced).agg(F.count("*").alias("scoring_units_total"), F.sum("legs").alias("legs_in_scope"), F.try_divide(F.count_if("beat"), F.count("*")).alias("baseline_beat_rate"))
    return counts.crossJoin(units)  # one row each


def turnover_of(scored: DataFrame, betslips: DataFrame) -> DataFrame:
    """Betslips of scored windows, for their money by currency."""
    return betslips.join(scored.select("uid"), "uid", "left_semi")
