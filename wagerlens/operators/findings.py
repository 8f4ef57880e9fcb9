"""Small figures that readers of the reports derive: shares, peaks, ranks, freshness, and a table's view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio4
from ..sources.pruning import pruned
from . import breakdown, legs as leg_ops
from .money import by_currency

#: Seconds up to which an artifact counts as fresh, ageing or stale.
FRESHNESS = ((15, "fresh"), (120, "ageing"), (900, "stale"))


def key_findings(phases: DataFrame) -> DataFrame:
    """From the phase table: share of pre-match legs, and the busiest phase with its share (the earlier on ties)."""
    total = F.sum("legs")
    peak = F.min_by(F.struct("phase", "share"), F.struct(-F.col("legs"), F.col("position")))
    return phases.agg(
        ratio4(F.sum(F.when(F.col("is_pre_match"), F.col("legs")).otherwise(0)), total).alias("pre_match_share"),
        peak["phase"].alias("peak_phase"),
        peak["share"].alias("peak_share"),
    )


def ranked_currencies(betslips: DataFrame) -> DataFrame:
    """Currencies by turnover, the unresolved bucket last; a rank orders amounts, it doesn't add them."""
    rows = by_currency(betslips)
    return rows.orderBy(F.col("currency").isNull(), F.desc("amount"), "currency")


def freshness(seconds: float | None) -> str:
    """What an artifact's age stands for."""
    if seconds is None:
        return "unknown"
    return next((tone for limit, tone in FRESHNESS if seconds <= limit), "down")


def oldest(ages: list[float]) -> float | None:
    """A page is as old as its oldest artifact."""
    return max(ages, default=None)


def current_legs(log: DataFrame, where: str | None = None) -> DataFrame:
    """The scan of the current state, with an optional predicate over identity columns.

    The predicate runs on what versions can't change, so it is pushed below the collapse to the log's files.
    """
    immutable = set(leg_ops.IMMUTABLE) | {"row_key", "placed_month", "fixture", "competition"}
    if where:
        wanted = F.expr(where)
        mutable = [c for c in log.columns if c not in immutable and c.lower() in where.lower()]
        return leg_ops.collapse(log).filter(wanted) if mutable else leg_ops.collapse(pruned(log, where))
    return leg_ops.collapse(log)


def by_dimension(legs: DataFrame, betslips: DataFrame, dimension: str, **more) -> tuple[DataFrame, DataFrame]:
    """A breakdown by name, of the dimensions that exist and no other."""
    for frame, names in ((legs, breakdown.LEG_DIMENSIONS), (betslips, breakdown.SLIP_DIMENSIONS)):
        if (known := f"by_{dimension}") in names:
            key, label = names[known]
            return breakdown.breakdown(frame, key, label=F.col(label) if label else None, **more)
    raise ValueError(f"no dimension {dimension!r}")


def view(table: DataFrame, *, label: str, contains: str = "", order: str | None = None, descending: bool = True, limit: int = 100) -> DataFrame:
    """A reader's view of a table: rows whose label contains a text, whatever its case, by one column."""
    rows = table.filter(F.contains(F.lower(F.col(label)), F.lit(contains.lower()))) if contains else table
    if order:
        rows = rows.orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), label)
    return rows.limit(limit)
