"""Concentration: Gini coefficient, Lorenz curve and top shares of any number of populations at once.

Populations are told apart by a key.  A large population is not ranked in one task: its values are dealt into
ranges (functions.ranks), and ranks within a range start where the ranges before end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.ranks import running
from ..sources.staged import written


def ranked(units: DataFrame, *, key: str = "population", value: str = "value") -> DataFrame:
    """Adds rank (1.. ascending by value), cumulative, n and total to (key, value), values null or < 0 left out.

    Equal values are one row with `many` units, which is exact for all of the measures: a rank is the last
    of its value's units, a cumulative sum includes all of them.
    """
    clean = units.filter(F.col(value).isNotNull() & (F.col(value) >= 0))
    distinct = clean.groupBy(key, value).agg(F.count("*").alias("many"))
    rows = running(written(distinct.withColumn("amount", F.col(value) * F.col("many"))), value, ["many", "amount"], [key])
    return rows.select(
        key, F.col(value).alias("value"), "many", F.col("upto_many").alias("rank"), F.col("upto_amount").alias("cumulative"), F.col("all_many").alias("n"), F.col("all_amount").alias("total")
    )


def gini(units: DataFrame, *, key: str = "population", least: int = 2) -> DataFrame:
    """Per population of at least `least` units and a positive total: n_units, total, gini (4 decimals)."""
    rows = ranked(units, key=key)
    many, last = F.col("many").cast("decimal(38,0)"), F.col("rank").cast("decimal(38,0)")
    ranks = (2 * last - many + 1) * many / 2  # sum of the ranks of this value's units
    sums = rows.groupBy(key, "n", "total").agg(F.sum((ranks.cast("decimal(24,0)") * F.col("value").cast("decimal(14,2)"))).alias("weighted"))
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    g = 2.0 * F.col("weighted").cast("double") / (n * total) - (n + 1) / n
    return sums.filter((F.col("n") >= least) & (F.col("total") > 0)).select(
        key, F.col("n").alias("n_units"), total.alias("total"), F.round(g, 4).alias("gini")
    )


def top_shares(units: DataFrame, *, key: str = "population", least: int = 2) -> DataFrame:
    """Per population: the share of the largest 1, 5 and 10 per cent of units and of the largest 10 units.

    cut, units, share (4 decimals).  Counts round half to even and are 1 at least.
    """
    rows = ranked(units, key=key).filter((F.col("n") >= least) & (F.col("total") > 0))
    cuts = F.array(
        *[F.struct(F.lit(name).alias("cut"), F.greatest(F.lit(1).cast("long"), F.bround(F.col("n") * part).cast("long")).alias("units")) for name, part in (("top_1pct", 0.01), ("top_5pct", 0.05), ("top_10pct", 0.10))],
        F.struct(F.lit("top_10_units").alias("cut"), F.least(F.lit(10).cast("long"), F.col("n")).alias("units")),
    )
    rows = rows.withColumn("c", F.explode(cuts))
    # of this value's units, those among the largest c.units
    above = F.col("n") - F.col("rank")
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("many"), F.col("c.units") - above))
    share = F.sum(F.col("value") * inside).cast("double") / F.first(F.col("total")).cast("double")
    return rows.groupBy(key, F.col("c.cut").alias("cut"), F.col("c.units").alias("units")).agg(F.round(share, 4).alias("share"))


def lorenz(units: DataFrame, *, key: str = "population", points: int = DEFAULTS.lorenz_points, least: int = 2) -> DataFrame:
    """Per population: `points` points (p, share), linear between the units' cumulative shares (6 decimals)."""
    rows = ranked(units, key=key).filter((F.col("n") >= least) & (F.col("total") > 0))
    first = F.col("rank") - F.col("many")
    steps = F.lit(points - 1)
    # grid points p = i / steps in (first / n, rank / n], and 0 for the lowest value
    low = F.floor(first * steps / F.col("n")) + F.when(first > 0, 1).otherwise(0)
    high = F.floor(F.col("rank") * steps / F.col("n"))
    rows = rows.withColumn("i", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    p = F.col("i") / steps
    base = (F.col("cumulative") - F.col("value") * F.col("many")).cast("double")
    share = (base + F.col("value").cast("double") * (p * F.col("n") - (F.col("rank") - F.col("many")))) / F.col("total").cast("double")
    return rows.select(key, F.col("i").alias("point"), F.round(p, 4).alias("p"), F.round(share, 6).alias("share"))


def populations(legs: DataFrame, betslips: DataFrame, *, least_slips: int = DEFAULTS.gini_betslips, least_fixtures: int = DEFAULTS.gini_fixtures) -> DataFrame:
    """The four populations as (population, value): turnover of Uids by currency, betslips of Uids, legs of
    fixtures, turnover of fixtures by currency."""
    return populations_of(stake_sums(betslips), fixture_sums(legs), least_slips=least_slips, least_fixtures=least_fixtures)


def stake_sums(betslips: DataFrame) -> DataFrame:
    """Betslips and turnover by currency and Uid."""
    return betslips.groupBy("currency", "uid").agg(F.count("*").alias("n"), F.sum("turnover").alias("turnover"))


def fixture_sums(legs: DataFrame) -> DataFrame:
    """Legs and turnover by currency and fixture."""
    return legs.groupBy("currency", "match_id").agg(F.count("*").alias("n"), F.sum("turnover").alias("turnover"))


def populations_of(by_uid: DataFrame, by_fixture: DataFrame, *, least_slips: int = DEFAULTS.gini_betslips, least_fixtures: int = DEFAULTS.gini_fixtures) -> DataFrame:
    """The populations from stake_sums and fixture_sums."""
    many = lambda: F.sum("n").cast("decimal(28,2)").alias("value")
    slips, per_fixture = by_uid.groupBy("uid").agg(many()), by_fixture.groupBy("match_id").agg(many())
    known = F.col("currency").isNotNull()
    enough = by_uid.filter(known).groupBy("currency").agg(F.sum("n").alias("slips")).filter(F.col("slips") >= least_slips).select("currency")
    by_uid = by_uid.filter(known).join(enough, "currency", "left_semi").withColumnRenamed("turnover", "value")
    wide = by_fixture.filter(known).groupBy("currency").agg(F.count("*").alias("fixtures")).filter(F.col("fixtures") >= least_fixtures).select("currency")
    fixture_money = by_fixture.filter(known).join(wide, "currency", "left_semi").withColumnRenamed("turnover", "value")
    parts = [
        by_uid.select(F.concat(F.lit("uid_turnover:"), "currency").alias("population"), "value"),
        slips.select(F.lit("uid_betslips").alias("population"), "value"),
        per_fixture.select(F.lit("fixture_legs").alias("population"), "value"),
        fixture_money.select(F.concat(F.lit("fixture_turnover:"), "currency").alias("population"), "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
