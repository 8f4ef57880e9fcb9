"""Refresh class 1 from sums that every batch corrects: a tick reads the months it touches, not the log.

Two tables are kept beside the log, by month and batch.  cells has legs, betslips and turnover by dimension, key and
currency; sets has, for dimensions of which a betslip may have several keys, how many betslips have a set of keys.
Legs of one Uid and second decide each other's betslips and nothing else does, so a batch changes exactly the
contribution of the Uids and seconds it names: what they gave before it is subtracted, what they give now is added.
A superseding version so takes its old facts back, a late one changes nothing, and a repeated batch replaces its own
corrections.  Sums over all batches are those of a recomputation; they are the inputs of the same tables.

Sets of keys make the count of betslips in the rest of a breakdown exact: a betslip counts once there however many
of its keys are not in the head.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BUILDER_MARKETS, DEFAULTS
from ..functions.clock import phase
from ..operators import breakdown, legs as leg_ops, money, players, timing
from ..plans.artifacts import LONGEST, envelope, rows_of
from ..sources.pruning import month_of
from .refresh import _cut, _with_money, snapshot

CELLS = "placed_month string, batch string, dimension string, key string, label string, currency string, n long, legs long, turnover decimal(38,2)"
SETS = "placed_month string, batch string, dimension string, keys array<string>, betslips long"
BATCHES = "placed_month string, batch string, n long, position long"
#: Keys of legs (column, label) and of betslips; of the first a betslip may have several.
LEG_KEYS = {"market_normalised": None, "competition": None, "match_id": "fixture", "selection": None, "phase": None}
SLIP_KEYS = ("region", "bet_type", "day")
LABEL = "market string, market_normalised string, player string, selection string"
NULL = "__null__"


def _known():
    return F.when(money.known(F.col("currency")), F.col("currency")).alias("currency")


def contributions(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, sets) of enriched legs, by placed_month."""
    rows = legs.withColumns({
        "placed_month": month_of(F.col("placed_at")),
        "phase": phase(F.col("minutes_to_kickoff")),
        "selection": F.to_json(F.struct(*[F.col(f.split()[0]) for f in LABEL.split(", ")])),
    })
    entry = lambda d, key, label=None: F.struct(F.lit(d).alias("dimension"), key.cast("string").alias("key"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))
    of_leg = [entry("all", F.lit(None)), entry("uid", F.col("uid")), entry("is_inplay", F.col("is_inplay"))] + [entry(d, F.col(d), label) for d, label in LEG_KEYS.items()]
    leg_cells = rows.select("placed_month", F.explode(F.array(*of_leg)).alias("e"), _known(), F.lit(1).alias("legs"), "turnover")
    slips = leg_ops.betslips(legs).withColumn("day", F.to_date("placed_at"))
    of_slip = [entry("slip", F.lit(None))] + [entry(d, F.col(d)) for d in SLIP_KEYS]
    slip_cells = slips.select(month_of(F.col("placed_at")).alias("placed_month"), F.explode(F.array(*of_slip)).alias("e"), _known(), "legs", "turnover")
    cells = leg_cells.unionByName(slip_cells).groupBy("placed_month", "e.dimension", "e.key", "e.label", "currency").agg(
        F.count("*").alias("n"), F.sum("legs").cast("long").alias("legs"), F.coalesce(F.sum("turnover"), F.lit(0)).cast("decimal(38,2)").alias("turnover")
    )
    per_slip = rows.groupBy("placed_month", "betslip_id").agg(*[F.sort_array(F.collect_set(F.col(d).cast("string") if d == "phase" else F.coalesce(F.col(d).cast("string"), F.lit(NULL)))).alias(d) for d in LEG_KEYS])
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("keys")) for d in LEG_KEYS]))
    sets = per_slip.select("placed_month", each.alias("e")).groupBy("placed_month", "e.dimension", "e.keys").agg(F.count("*").alias("betslips"))
    return cells, sets.filter(F.size("keys") > 0)


def _difference(after: DataFrame, before: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """What a batch adds to each sum; negative where it takes back."""
    keys = [c for c in after.columns if c not in measures]
    minus = before.select(*keys, *[(-F.col(m)).cast(after.schema[m].dataType).alias(m) for m in measures])
    return summed(after.unionByName(minus), keys, measures)


def summed(rows: DataFrame, keys: list[str], measures: tuple[str, ...]) -> DataFrame:
    """Sums by keys, without those that are all zero."""
    out = rows.groupBy(*keys).agg(*[F.sum(m).cast(rows.schema[m].dataType).alias(m) for m in measures])
    nothing = F.lit(True)
    for m in measures:
        nothing = nothing & (F.col(m) == 0)
    return out.filter(~nothing)


MEASURES = {"cells": ("n", "legs", "turnover"), "sets": ("betslips",)}
SCHEMAS = {"cells": CELLS, "sets": SETS, "batches": BATCHES}


def _write(rows: DataFrame, path: str, name: str, batch: str) -> None:
    writer = rows.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("placed_month", "batch").parquet(f"{path}/{name}")


def update(log: DataFrame, rows: DataFrame, path: str, batch: str) -> list[str | None]:
    """Correct the sums at path for a batch of versions that is in the log under its name; returns the months touched.

    log has the columns placed_month and batch.  Of the log only the touched months' folders are read, and of these
    the Uids and seconds that the batch names.  Batches are corrected in their order, each before its month is compacted.
    """
    months = [r[0] for r in rows.select(month_of(F.col("placed_at"))).distinct().collect()]  # a row a month of the batch
    named = [m for m in months if m is not None]
    there = F.col("placed_month").isin(named) if named else F.lit(False)
    there = there | F.col("placed_month").isNull() if None in months else there
    touched = rows.select(leg_ops.second_of().alias("base_id")).distinct()
    mine = log.filter(there).withColumn("base_id", leg_ops.second_of()).join(touched, "base_id", "left_semi").drop("base_id").persist()
    now, was = snapshot(mine).persist(), snapshot(mine.filter(F.col("batch") != batch)).persist()
    try:
        for name, a, b in zip(("cells", "sets"), contributions(now), contributions(was), strict=True):
            _write(_difference(a, b, MEASURES[name]), path, name, batch)
        stored = mine.filter(F.col("batch") == batch).groupBy("placed_month").agg(F.count("*").alias("n"), F.max("version").alias("position"))
        _write(stored, path, "batches", batch)
    finally:
        for df in (now, was, mine):
            df.unpersist()
    return months


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The corrections of a table; none if nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def current(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, sets) by month, summed over batches."""
    out = []
    for name in ("cells", "sets"):
        rows = read(spark, path, name).drop("batch")
        out.append(summed(rows, [c for c in rows.columns if c not in MEASURES[name]], MEASURES[name]))
    return out[0], out[1]


def fold(spark: SparkSession, path: str, month: str, stored: int) -> None:
    """One correction for all of a month's, once the month's log is compacted to so many rows."""
    folder = f"placed_month={month}"
    for name in SCHEMAS:
        rows = read(spark, path, name).filter(F.col("placed_month") == month)
        old = [r["batch"] for r in rows.select("batch").distinct().collect()]
        if name == "batches":
            one = rows.groupBy("placed_month").agg(F.lit(stored).cast("long").alias("n"), F.max("position").alias("position"))
        else:
            plain = rows.drop("batch")
            one = summed(plain, [c for c in plain.columns if c not in MEASURES[name]], MEASURES[name])
        # beside the table, then in place of all of the month's by two renames: a reader never adds old and new
        files = spark._jvm.org.apache.hadoop.fs
        at = files.Path(f"{path}/{name}/{folder}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        aside = f"{path}/_folding/{name}-{month}"
        one.drop("placed_month").coalesce(1).write.mode("overwrite").parquet(f"{aside}/batch=fold")
        fs.delete(files.Path(f"{aside}-old"), True)
        if old and not (fs.rename(at, files.Path(f"{aside}-old")) and fs.rename(files.Path(aside), at)):
            raise OSError(f"could not fold {at}")
        fs.delete(files.Path(f"{aside}-old"), True)


def _betslips_of(sets: DataFrame, target: DataFrame | None = None):
    """Counts betslips by bucket from sets of keys; target (k, target) maps keys to those that are ranked."""

    def count(head: DataFrame) -> DataFrame:
        rows = sets.groupBy("keys").agg(F.sum("betslips").alias("betslips")).select("keys", "betslips", F.explode("keys").alias("k"))
        rows = rows.withColumn("target", F.col("k")) if target is None else rows.join(target, "k")
        rows = rows.join(head, F.col("target") == F.col("head_bucket"), "left").withColumn("bucket", F.coalesce("head_bucket", F.lit(breakdown.OTHER)))
        once = rows.groupBy("keys", "bucket").agg(F.max("betslips").alias("betslips"))
        return once.groupBy("bucket").agg(F.sum("betslips").alias("betslips"))

    return count


def _by(cells: DataFrame, key: str, label: str) -> DataFrame:
    """Sums by key and currency, as ranked() takes them."""
    return cells.groupBy(F.expr(key).alias("of_key"), "currency").agg(F.sum("n").alias("legs"), F.sum("turnover").alias("amount"), F.min(label).alias("label"))


def _flow(cells: DataFrame, sets: DataFrame) -> dict:
    of = lambda d: cells.filter(F.col("dimension") == d)
    sets_of = lambda d: sets.filter(F.col("dimension") == d)
    parts = {}
    for name, (key, label) in breakdown.LEG_DIMENSIONS.items():
        parts[name] = breakdown.ranked(_by(of(key), "cast(key AS long)" if key == "match_id" else "key", "label" if label else "key"), _betslips_of(sets_of(key)))
    for name, (key, _) in breakdown.SLIP_DIMENSIONS.items():
        sums = _by(of(key), "key", "key")
        parts[name] = breakdown.ranked(sums, lambda head, sums=sums: breakdown.dealt(sums, "of_key", head).groupBy("bucket").agg(F.sum("legs").alias("betslips")))
    labels = of("selection").withColumn("of", F.from_json("key", LABEL)).select("key", "of.*", "currency", "n", "turnover")
    pool = of("market_normalised").filter(~F.col("key").isin(*BUILDER_MARKETS.values())).groupBy("key").agg(F.sum("n").alias("n"))
    busiest = pool.orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(DEFAULTS.selection_markets).select(F.col("key").alias("market_normalised"))
    scoped = breakdown.labelled(labels.join(F.broadcast(busiest), "market_normalised", "left_semi"))
    parts["by_selection"] = breakdown.ranked(_by(scoped, "selection_key", "selection_label"), _betslips_of(sets_of("selection"), scoped.select(F.col("key").alias("k"), F.col("selection_key").alias("target")).distinct()))
    named = players.resolve(labels).filter("player_name IS NOT NULL")
    parts["by_player"] = breakdown.ranked(_by(named, "player_name", "player_name"), _betslips_of(sets_of("selection"), named.select(F.col("key").alias("k"), F.col("player_name").alias("target")).distinct()))
    return {name: _with_money(counts, sums, "key") for name, (counts, sums) in parts.items()}


def _universe(cells: DataFrame) -> DataFrame:
    per = cells.groupBy("dimension", "key").agg(F.sum("n").alias("n"))
    of = lambda d: F.col("dimension") == d
    some = lambda d: F.count_if(of(d) & F.col("key").isNotNull() & (F.col("n") > 0))
    number = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return per.agg(
        number(of("all")).alias("legs"), F.min(F.when(of("day"), F.col("key"))).alias("first_day"), F.max(F.when(of("day"), F.col("key"))).alias("last_day"),
        number(of("is_inplay") & (F.col("key") == "true")).alias("inplay_legs"), number(of("slip")).alias("betslips"),
        some("uid").alias("uids"), some("match_id").alias("fixtures"), some("competition").alias("competitions"), some("market_normalised").alias("markets"),
    )


def _overview(cells: DataFrame) -> dict:
    slips, legs = cells.filter("dimension = 'slip'"), cells.filter("dimension = 'all'")
    over = lambda rows, name: rows.filter("currency IS NOT NULL").groupBy("currency").agg(F.sum("turnover").alias(name))
    months = slips.groupBy(F.col("placed_month").alias("month")).agg(F.sum("n").alias("betslips"))
    order = [F.asc_nulls_last("currency")]
    return {"universe": rows_of(_universe(cells))} | _cut(
        money=(slips.groupBy("currency").agg(F.sum("n").alias("n_rows"), F.sum("turnover").alias("amount")), order, LONGEST),
        inflation=(money.ratio(over(legs, "leg_turnover"), over(slips, "betslip_turnover")), order, LONGEST),
        monthly=(timing.shares(months), [F.desc("month")], LONGEST),
    )


def _timing(cells: DataFrame, sets: DataFrame) -> dict:
    phased = cells.filter("dimension = 'phase' AND key IS NOT NULL")
    slips = sets.filter("dimension = 'phase'").select(F.explode("keys").alias("phase"), "betslips").groupBy("phase").agg(F.sum("betslips").alias("betslips"))
    found = phased.groupBy(F.col("key").alias("phase")).agg(F.sum("n").alias("legs")).join(slips, "phase", "left")
    total = cells.filter("dimension = 'all'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    sums = phased.groupBy(F.col("key").alias("phase"), "currency").agg(F.sum("n").alias("n_rows"), F.sum("turnover").alias("amount"))
    days = cells.filter("dimension = 'day'").groupBy(F.col("key").cast("date").alias("day")).agg(F.sum("n").alias("betslips"), F.sum("legs").alias("legs"))
    return {"phases": _with_money(timing.phase_table(found, total), sums, "phase")} | _cut(daily=(timing.operating(days), [F.desc("day")], LONGEST))


def class_one(spark: SparkSession, path: str) -> dict[str, dict]:
    """overview, flow and timing from the sums at path, as refresh() makes them from the log."""
    began = time.time()
    cells, sets = (df.persist() for df in current(spark, path))
    try:
        data = {"overview": _overview(cells), "flow": _flow(cells, sets), "timing": _timing(cells, sets)}
        stored = read(spark, path, "batches").agg(F.max("position").alias("position"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_stored")).first().asDict()
        identities = data["overview"]["universe"][0]["legs"]
    finally:
        cells.unpersist()
        sets.unpersist()
    meta = stored | {"identities": identities, "pending_supersedence": stored["rows_stored"] - identities, "seconds": round(time.time() - began, 3)}
    return {name: envelope(name, part, meta) for name, part in data.items()}
