"""Who a leg is about, in markets about one player.

Template markets carry the name after a label prefix that all labels of the market share; the prefix is
derived from the data, as that of the smallest and the largest label.  Other markets have the name in the
selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_name

#: Suffixes of labels, and markets whose selection is a name or, despite that, is none.
STAR_SUFFIX = r"(?i)\s*\((?:Suplente Estrella|Jugador Estrella|Star Substitute)\)\s*$"
NAME_IN_SELECTION = r"(?i)goal ?scorer|to score|to be carded|hat trick|most passes|assist"
NOT_A_PLAYER = r"(?i)^(?:team|match)\b"
TEMPLATE = r"(?i)\{PLAYER\}"


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common beginning, without spaces at its end; of a group's least and greatest it is the group's."""
    places = F.sequence(F.lit(1), F.least(F.length(low), F.length(high)))
    some = F.when(F.least(F.length(low), F.length(high)) > 0, places).otherwise(F.array().cast("array<int>"))
    n = F.aggregate(
        some,
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i).otherwise(n),
    )
    return F.rtrim(F.substr(low, F.lit(1), n))


def resolve(legs: DataFrame) -> DataFrame:
    """Adds player_family (template_player, name_in_option, not_player_centric) and player_name (or null)."""
    is_template = F.coalesce(F.col("market").rlike(TEMPLATE), F.lit(False))
    in_option = ~is_template & F.coalesce(F.col("market_normalised").rlike(NAME_IN_SELECTION), F.lit(False)) & ~F.coalesce(
        F.col("market_normalised").rlike(NOT_A_PLAYER), F.lit(False)
    )
    label = F.trim(F.regexp_replace("player", STAR_SUFFIX, ""))
    rows = legs.select("*", is_template.alias("is_template"), in_option.alias("in_option"), label.alias("name_label"))
    prefixes = rows.filter("is_template").groupBy(F.col("market").alias("prefix_market")).agg(
        common_prefix(F.min("name_label"), F.max("name_label")).alias("prefix")
    )
    rows = rows.join(prefixes, (F.col("market") == F.col("prefix_market")) & F.col("is_template"), "left")
    stripped = F.trim(F.substr("name_label", F.length("prefix") + 1))
    option = F.trim("selection")
    name = F.when(F.col("is_template") & looks_like_name(stripped), stripped).when(F.col("in_option") & looks_like_name(option), option)
    family = F.when(F.col("is_template"), "template_player").when(F.col("in_option"), "name_in_option").otherwise("not_player_centric")
    return rows.select(*legs.columns, family.alias("player_family"), name.alias("player_name"))


def coverage(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count_if(F.col("player_family") != "not_player_centric").alias("player_centric_legs"),
        F.count_if(F.col("player_family") == "template_player").alias("template_legs"),
        F.count_if(F.col("player_family") == "name_in_option").alias("option_legs"),
        F.count("player_name").alias("named_legs"),
        F.countDistinct("player_name").alias("names"),
    )
