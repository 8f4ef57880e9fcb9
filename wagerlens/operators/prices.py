"""Reference prices, the value of prices taken, and price movement.

Values are whole millionths, rounded half up, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.lookups import bitmap, sieved
from ..functions.odds import milli
from ..functions.stats import floor_div
from ..sources.staged import written
from .legs import ORDER

GROUP = ("match_id", "market_normalised", "player", "selection")


def in_scope() -> Column:
    """Pre-match legs at a real price, of a complete price group."""
    complete = F.lit(True)
    for c in GROUP:
        complete = complete & F.col(c).isNotNull()
    return ~F.col("is_inplay") & (F.col("price") > 1) & complete


def value_micro(taken: Column, reference: Column) -> Column:
    """taken / reference - 1 in millionths, both prices in thousandths."""
    return floor_div(2 * taken * 1_000_000 + reference, 2 * reference) - 1_000_000


def price_groups(legs: DataFrame) -> DataFrame:
    """Of each price group, its last leg, its size and whether its price moves."""
    return legs.filter(F.coalesce(in_scope(), F.lit(False))).groupBy(*GROUP).agg(
        F.max(F.struct(*ORDER, F.col("price").alias("last_price"), F.col("uid").alias("last_uid"))).alias("last"),
        F.count("*").alias("group_size"),
        (F.min("price") < F.max("price")).alias("group_moves"),
    )


def large_price_groups(legs: DataFrame) -> DataFrame:
    """price_groups of a large book (written, as it is read twice), written: sizes, prices and last times first, as numbers;
    only legs at such a time, and a few that share a hash with one, are then compared in the whole order."""
    scope = legs.filter(F.coalesce(in_scope(), F.lit(False)))
    sums = scope.groupBy(*GROUP).agg(F.max("placed_at").alias("placed_at"), F.count("*").alias("group_size"), F.min("price").alias("low"), F.max("price").alias("high"))
    sums, at = written(sums), [*GROUP, "placed_at"]
    ends = price_groups(sieved(scope, at, bitmap(sums.select(F.xxhash64(*at).alias("h"))))).select(*GROUP, "last")
    return written(ends.join(sums, list(GROUP)).select(*GROUP, "last", "group_size", (F.col("low") < F.col("high")).alias("group_moves")))


def attach_value(
    legs: DataFrame, *, among: DataFrame | None = None, groups: DataFrame | None = None, row_key: Column | None = None, strict_ties: bool = False, winsor: int = DEFAULTS.winsor_micro
) -> DataFrame:
    """Add reference_price, value_micro, value_winsorised, value_eligible, reference_is_own_bet,
    group_leg_count and group_price_moves.

    The reference is the group's last price, and every leg before the last has one; with strict_ties only
    legs at an earlier time.  Legs out of scope keep nulls.  A group's last leg is found by an aggregation,
    combined before its shuffle, and joined back: Spark splits the legs of a hot group over several tasks,
    which it can't for a window.  Legs equal in the whole order are one observation.

    legs may be some of a book's; among then has all legs of their groups, or groups is what price_groups made of them.
    row_key makes the identity of legs that come without it: it is then no part of what is dealt by group.
    """
    scope = F.coalesce(in_scope(), F.lit(False))
    groups = groups if groups is not None else price_groups(legs if among is None else among)
    rows = legs.withColumn("in_scope", scope).join(groups, list(GROUP), "left")
    if row_key is not None:
        rows = rows.withColumn("row_key", row_key)
    order = F.struct(*[F.col(c) for c in ORDER])
    earlier = F.col("placed_at") < F.col("last.placed_at")
    later = earlier if strict_ties else F.when(earlier, True).otherwise(order < F.struct(*[F.col(f"last.{c}") for c in ORDER]))
    eligible = F.col("in_scope") & F.coalesce(later, F.lit(False))
    rows = rows.withColumn("value_eligible", eligible)
    micro = F.when(F.col("value_eligible"), value_micro(milli(F.col("price")), milli(F.col("last.last_price"))))
    rows = rows.withColumn("value_micro", micro)
    clipped = F.greatest(F.least("value_micro", F.lit(winsor)), F.lit(-winsor))
    return rows.select(
        *legs.columns, *(["row_key"] if row_key is not None else []),
        F.when(F.col("value_eligible"), F.col("last.last_price")).alias("reference_price"),
        "value_micro",
        F.when(F.col("value_micro").isNotNull(), clipped).alias("value_winsorised"),
        "value_eligible",
        F.coalesce(F.col("value_eligible") & (F.col("uid") == F.col("last.last_uid")), F.lit(False)).alias("reference_is_own_bet"),
        F.when(F.col("in_scope"), F.col("group_size")).otherwise(0).alias("group_leg_count"),
        (F.col("in_scope") & F.coalesce("group_moves", F.lit(False))).alias("group_price_moves"),
    )


def coverage(priced: DataFrame) -> DataFrame:
    """One row: how many legs and groups the price value covers, and how often it is positive."""
    scope = priced.filter(in_scope())
    groups = scope.groupBy(*GROUP).agg(F.count("*").alias("n"), (F.min("price") < F.max("price")).alias("moves"))
    return _coverage(coverage_counts(priced), groups)


def coverage_counts(priced: DataFrame) -> DataFrame:
    """One row of counts of legs, which add up over slices of a book."""
    return priced.agg(
        F.count_if(in_scope()).alias("pre_match_legs"),
        F.count_if("is_inplay").alias("inplay_legs_excluded"),
        F.count_if("value_eligible").alias("eligible_legs"),
        F.count_if("reference_is_own_bet").alias("reference_from_same_uid"),
        F.count_if(F.col("value_eligible") & ~F.col("reference_is_own_bet")).alias("reference_from_other_uid"),
        F.count_if(F.col("value_winsorised") > 0).alias("beats"),
    )


def coverage_of_slices(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """coverage from the coverage_counts of a book's slices and its price_groups."""
    return _coverage(counts.agg(*[F.sum(c).alias(c) for c in counts.columns]), groups.select(F.col("group_size").alias("n"), F.col("group_moves").alias("moves")))


def _coverage(of_legs: DataFrame, groups: DataFrame) -> DataFrame:
    of_groups = groups.agg(
        F.count("*").alias("groups_total"),
        F.count_if("moves").alias("groups_with_variation"),
        F.count_if(F.col("n") >= DEFAULTS.movement_group).alias("groups_for_movement"),
    )
    both = of_legs.crossJoin(of_groups)  # one row each
    return both.withColumn(
        "population_beat_rate", F.when(F.col("eligible_legs") > 0, F.col("beats") / F.col("eligible_legs"))
    )


def movement(legs: DataFrame, *, least_group: int = DEFAULTS.movement_group, sharp_move: float = DEFAULTS.sharp_move, sharp_uids: int = DEFAULTS.sharp_move_uids) -> DataFrame:
    """Per price group of at least `least_group` legs: first and last price and the move of the implied
    probability; turnover and currency only where the group has one currency."""
    order = F.struct(*ORDER)
    currency = F.countDistinct("currency")
    grouped = legs.filter(in_scope()).groupBy(*GROUP).agg(
        F.count("*").alias("legs"),
        F.min_by("price", order).alias("first_price"),
        F.max_by("price", order).alias("last_price"),
        F.min_by("fixture", order).alias("fixture"),
        F.min_by("event_at", order).alias("kickoff"),
        F.sum("turnover").alias("turnover"),
        currency.alias("n_currencies"),
        F.min("currency").alias("currency"),
        F.countDistinct("uid").alias("distinct_uids"),
    )
    move = (1.0 / F.col("last_price").cast("double")) / (1.0 / F.col("first_price").cast("double")) - 1.0
    mixed = F.col("n_currencies") > 1
    return (
        grouped.filter(F.col("legs") >= least_group)
        .withColumn("implied_prob_move", move)
        .withColumn("direction", F.when(F.col("implied_prob_move") > 0, "steamer").otherwise("drifter"))
        .withColumn("is_sharp_move", (F.abs("implied_prob_move") >= sharp_move) & (F.col("distinct_uids") >= sharp_uids))
        .withColumn("turnover", F.when(~mixed, F.col("turnover")))
        .withColumn("currency", F.when(~mixed, F.col("currency")))
        .drop("n_currencies")
    )


def movers(moves: DataFrame, direction: str, *, limit: int = DEFAULTS.movers) -> DataFrame:
    """The largest sharp moves of one direction; the limit is the report's."""
    key = F.desc("implied_prob_move") if direction == "steamer" else F.asc("implied_prob_move")
    return moves.filter(F.col("is_sharp_move") & (F.col("direction") == direction)).orderBy(key, *GROUP).limit(limit)


#: Histogram edges of the price value, in thousandths.
EDGES = (-1000, -500, -250, -100, -50, -10, 0, 10, 50, 100, 250, 500, 1000)


def value_histogram(priced: DataFrame) -> DataFrame:
    """Legs by price value, clipped to the outer edges; bins are [low, high), the last closed; empty ones stay."""
    spark = priced.sparkSession
    bins = spark.createDataFrame([(i, lo / 1000.0, hi / 1000.0) for i, (lo, hi) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True))], "bin int, low double, high double")
    value = F.col("value_micro")
    number = F.lit(len(EDGES) - 2)
    for i in range(len(EDGES) - 3, -1, -1):
        number = F.when(value < EDGES[i + 1] * 1000, i).otherwise(number)
    found = priced.filter(value.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("legs"))
    return bins.join(found, "bin", "left").select("bin", "low", "high", F.coalesce("legs", F.lit(0)).alias("legs"))
