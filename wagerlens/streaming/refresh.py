"""Refresh classes: what is recomputed how often, from one collapsed snapshot, and the envelope around it."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, REFRESH_CLASSES
from ..operators import anomalies, breakdown, concentration, legs as leg_ops, money, players, prices, quality, sharp, timing
from ..plans.artifacts import LONGEST, cut, envelope, rows_of
from ..sources.pruning import pruned
from ..sources.sinks import write_json


def snapshot(log: DataFrame) -> DataFrame:
    """The current legs, enriched: all classes read this and nothing else."""
    return leg_ops.enrich(leg_ops.collapse(log).drop("region", "market_normalised", "is_inplay", "minutes_to_kickoff", "placed_month", "batch"))


def _with_money(counts: DataFrame, sums: DataFrame, key: str) -> dict:
    """A table of few keys, and its amounts by currency, of which there may be many."""
    cut = _cut(money=(sums, [F.asc_nulls_last("currency"), F.asc(key)], LONGEST))
    return {"rows": rows_of(counts)} | cut


def _overview(legs: DataFrame) -> dict:
    slips = leg_ops.betslips(legs)
    order = [F.asc_nulls_last("currency")]
    return {
        "universe": rows_of(leg_ops.universe(legs)),
    } | _cut(
        money=(money.by_currency(slips), order, LONGEST), inflation=(money.inflation(legs, slips), order, LONGEST),
        monthly=(timing.monthly(slips), [F.desc("month")], LONGEST),
    )


def _flow(legs: DataFrame) -> dict:
    slips, named = leg_ops.betslips(legs), players.resolve(legs)
    parts = {name: breakdown.breakdown(legs, key, label=F.col(label) if label else None) for name, (key, label) in breakdown.LEG_DIMENSIONS.items()}
    parts |= {name: breakdown.breakdown(slips, key) for name, (key, _) in breakdown.SLIP_DIMENSIONS.items()}
    parts["by_selection"] = breakdown.breakdown(breakdown.selections(legs), "selection_key", label=F.col("selection_label"))
    parts["by_player"] = breakdown.breakdown(named.filter("player_name IS NOT NULL"), "player_name")
    return {name: _with_money(counts, sums, "key") for name, (counts, sums) in parts.items()}


def _timing(legs: DataFrame) -> dict:
    counts, sums = timing.phases(legs)
    return {"phases": _with_money(counts, sums, "phase")} | _cut(daily=(timing.daily(leg_ops.betslips(legs)), [F.desc("day")], LONGEST))


def _prices(legs: DataFrame) -> dict:
    priced, moves = prices.attach_value(legs), prices.movement(legs)
    return {
        "coverage": rows_of(prices.coverage(priced)),
        "histogram": rows_of(prices.value_histogram(priced)),
        "steamers": rows_of(prices.movers(moves, "steamer")),
        "drifters": rows_of(prices.movers(moves, "drifter")),
    }


def _cut(**tables: tuple) -> dict:
    """cut() of tables of a page: (rows, order), and a limit if it is not DEFAULTS.table_rows."""
    return cut(**{name: (df, order, *(limit or (DEFAULTS.table_rows,))) for name, (df, order, *limit) in tables.items()})


def _anomalies(legs: DataFrame) -> dict:
    slips = leg_ops.betslips(legs)
    return _cut(
        turnover_spikes=(anomalies.turnover_spikes(slips), [F.desc("excess_ratio"), F.asc("currency"), F.asc("day")]),
        abnormal_exposure=(anomalies.abnormal_exposure(legs), [F.desc("share"), F.asc("currency"), F.asc("match_id")]),
        same_second_clusters=(anomalies.same_second_clusters(legs), [F.desc("cluster_size"), F.asc("uid"), F.asc("placed_at")]),
    )


def _repeats(legs: DataFrame) -> dict:
    backing = anomalies.repeat_backing(prices.attach_value(legs))
    moves = prices.movement(legs).filter("is_sharp_move")
    return _cut(
        repeat_backing=(backing, [F.desc("betslips"), F.desc("legs"), F.asc("uid"), F.asc("match_id"), F.asc("market_normalised"), F.asc("player"), F.asc("selection")]),
        sharp_moves=(moves, [F.desc(F.abs(F.col("implied_prob_move"))), F.asc("match_id"), F.asc("market_normalised"), F.asc("player"), F.asc("selection")]),
    )


def _anomalies_whole(legs: DataFrame) -> dict:
    first, second = _anomalies(legs), _repeats(legs)
    return first | second | {"truncation": first["truncation"] | second["truncation"]}


def _sharp(legs: DataFrame) -> dict:
    scored = sharp.score(prices.attach_value(legs))
    return _cut(flagged=(scored.filter("flagged"), [F.desc("score"), F.asc("uid")]))


def _sharp_whole(legs: DataFrame) -> dict:
    priced = prices.attach_value(legs)
    scored = sharp.score(priced)
    out = _cut(
        flagged=(scored.filter("flagged"), [F.desc("score"), F.asc("uid")]),
        eligible=(scored.filter(F.col("priced_units") >= DEFAULTS.flag_units), [F.desc("score"), F.asc("uid")], LONGEST),
    )
    return out | {"report": rows_of(sharp.report(priced, scored))}


def _concentration(legs: DataFrame) -> dict:
    units = concentration.populations(legs, leg_ops.betslips(legs))
    return _cut(
        gini=(concentration.gini(units), [F.asc("population")], LONGEST), top_shares=(concentration.top_shares(units), [F.asc("population"), F.asc("cut")], LONGEST),
        lorenz=(concentration.lorenz(units), [F.asc("population"), F.asc("point")], LONGEST),
    )


BUILDERS: dict[str, Callable[[DataFrame], dict]] = {
    "overview": _overview,
    "flow": _flow,
    "timing": _timing,
    "prices": _prices,
    "data_quality": lambda legs: {"quality": rows_of(quality.data_quality(legs)), "players": rows_of(players.coverage(players.resolve(legs)))},
    "concentration": _concentration,
    "anomalies": _anomalies_whole,
    "sharp": _sharp_whole,
}


def refresh(log: DataFrame, classes: tuple[int, ...] = (1, 2, 3), *, where: str | None = None) -> dict[str, dict]:
    """Artifacts of the named classes only; a class's work is not done for another.

    where: a condition on the log's immutable columns, which reaches its files; of one on placed_at its folders too.
    """
    began = time.time()
    log = pruned(log, where)
    position = leg_ops.stream_position(log).first().asDict()
    legs = snapshot(log).persist()
    try:
        out = {name: BUILDERS[name](legs) for c in classes for name in REFRESH_CLASSES[c][1]}
    finally:
        legs.unpersist()
    meta = position | {"seconds": round(time.time() - began, 3), "where": where, "intervals": {str(c): REFRESH_CLASSES[c][0] for c in classes}}
    return {name: envelope(name, data, meta) for name, data in out.items()}


def write(artifacts: dict[str, dict], folder: str) -> None:
    """One file an artifact, each replaced whole; artifacts of other classes stay as they are."""
    for name, value in artifacts.items():
        write_json(value, Path(folder) / f"{name}.json")
