"""Prices: decimals, fractions, probabilities and market codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Both providers' market tokens and the vocabulary they map to.
MARKET_TYPES = {
    "ou_total_goals": "total_goals",
    "total_goals": "total_goals",
    "btts": "btts",
    "player_shots_on": "player_shots_on_target",
    "player_shots_on_target": "player_shots_on_target",
    "player_goals": "player_goals",
    "player_to_score": "player_goals",
    "asian_handicap": "asian_handicap",
}


def milli(price: Column) -> Column:
    """A price with three decimals as a whole number of thousandths."""
    return (price.cast("decimal(10,3)") * 1000).cast("long")


def implied_probability(price: Column) -> Column:
    return F.when(price > 1, 1.0 / price.cast("double"))


def price_text(raw: Column) -> Column:
    """A price written with three decimals, for identities; what is no number stays as written."""
    return F.coalesce(raw.try_cast("decimal(10,3)").cast("string"), raw.cast("string"))


def fractional_to_decimal(fraction: Column) -> Column:
    """'4/5' to 1.8, four decimals; null for what is no fraction (strict=raise is the caller's choice)."""
    parts = F.split(fraction, "/")
    top, low = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")
    good = (F.size(parts) == 2) & top.isNotNull() & low.isNotNull() & (low != 0)
    return F.when(good, F.round((top.cast("decimal(18,0)") / low.cast("decimal(18,0)")) + 1, 4).cast("double"))


def require_fraction(fraction: Column) -> Column:
    """As fractional_to_decimal, but malformed odds end the query."""
    return F.coalesce(fractional_to_decimal(fraction), F.raise_error(F.concat(F.lit("not fractional odds: "), fraction)).cast("double"))


def canonical_market(token: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MARKET_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(token))), F.lit("unknown"))


def market_code(code: Column) -> Column:
    """'TYPE@player@line' as a struct: market_type, player_source_id, line, raw."""
    parts = F.split(code, "@")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    lines = F.filter(rest, lambda s: s.contains("."))
    players = F.filter(rest, lambda s: ~s.contains("."))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    return F.struct(
        canonical_market(F.element_at(parts, 1)).alias("market_type"),
        last(players).alias("player_source_id"),
        last(lines).cast("double").alias("line"),
        code.alias("raw"),
    )


def same_price(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 0.001
