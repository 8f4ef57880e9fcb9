"""Wire events: schema, generator, canonical form, ingest into the log."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clock import minutes_between
from ..functions.text import management_unit, market
from ..operators.legs import newest
from ..sources.lines import MAX_ROWS, read_line_stream
from ..sources.sinks import append_log
from ..sources.standin import row_key

EVENT = (
    "uid string, placed_at string, event_at string, bet_type string, match_id long, fixture string, competition string, market string, player string, "
    "selection string, region string, currency string, price double, turnover double, ggr double, net_revenue double, event_kind string, source string, "
    "is_inplay int, minutes_to_kickoff double, emitted_at long"
)


def read_event_files(spark: SparkSession, path: str, *, streaming: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    if streaming:
        return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(EVENT).json(path)


def read_event_rows(spark: SparkSession, path: str, checkpoint: str, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """JSON lines as a stream in batches of at most max_rows rows, for a query with that checkpoint."""
    lines = read_line_stream(spark, path, f"{checkpoint.rstrip('/')}-positions", max_rows=max_rows)
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")


def read_event_log(spark: SparkSession, brokers: str, topic: str, *, per_trigger: int = 10_000) -> DataFrame:
    """A Kafka topic from its beginning (needs the connector); the checkpoint commits what a sink has written."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
    raw = raw.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def canonicalise(events: DataFrame) -> DataFrame:
    """Events as rows of the log: instants parsed to UTC, decimals, normalised names, identity, version."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    known = lambda c: F.when(~F.lower(text(c)).isin("nan"), text(c))
    rows = events.select(
        "uid",
        F.try_to_timestamp("placed_at").alias("placed_at"),
        F.try_to_timestamp("event_at").alias("event_at"),
        "bet_type", "match_id", "fixture", "competition", "market", "player", "selection",
        F.col("region").alias("management_unit"),
        known("currency").alias("currency"),
        F.col("price").cast("decimal(10,3)").alias("price"),
        *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("turnover", "ggr", "net_revenue")],
        "event_kind", "source", F.col("emitted_at").alias("version"),
    )
    minutes = minutes_between(F.col("placed_at"), F.col("event_at"))
    return rows.select(
        row_key(rows).alias("row_key"), "*",
        market(F.col("market")).alias("market_normalised"), management_unit(F.col("management_unit")).alias("region"),
        F.coalesce(minutes > 0, F.lit(False)).alias("is_inplay"), minutes.alias("minutes_to_kickoff"),
        F.date_format("placed_at", "yyyy-MM").alias("placed_month"),
    )


def ingest(events: DataFrame, path: str, checkpoint: str, *, drain: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
    """Append canonical events to the log, by month.  Each batch has its own folders there, overwritten if it is
    repeated, so that a batch that ran twice is in the log once; the checkpoint advances after the write."""

    from .watch import watched

    def write(batch: DataFrame, batch_id: int) -> None:
        append_log(batch, path, batch=f"stream-{batch_id}")

    writer = watched(canonicalise(events)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return writer.start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's versions, with the month that is their folder."""
    return spark.read.parquet(path).drop("batch")


def latest_state(events: DataFrame) -> DataFrame:
    """The collapsed state as a streaming aggregation, for sinks in complete or update mode."""
    rows = canonicalise(events).drop("placed_month")
    rest = [c for c in rows.columns if c != "row_key"]
    return rows.groupBy("row_key").agg(F.max(newest(rest)).alias("now")).select("row_key", *[F.col(f"now.{c}") for c in rest])


def lag(progress: dict) -> dict[str, int]:
    """How far a query is behind its sources: records where offsets are numbers by topic and partition, batches
    of files where they are one number."""

    def ahead(latest, done) -> int:
        if isinstance(latest, dict):
            done = done if isinstance(done, dict) else {}
            return sum(ahead(v, done.get(k)) for k, v in latest.items())
        return int(latest) - int(done or 0) if isinstance(latest, (int, float)) else 0

    def read(offset):
        """Offsets come as values, or as the text of a JSON or Python value."""
        if not isinstance(offset, str):
            return offset or {}
        try:
            return json.loads(offset)
        except ValueError:
            return ast.literal_eval(offset) or {}

    return {s.get("description", ""): ahead(read(s.get("latestOffset")), read(s.get("endOffset"))) for s in progress.get("sources", [])}


# ---- generated events ----------------------------------------------------------------------------


def uniform(seed: int, salt: str, *of: Column) -> Column:
    """A number in [0, 1) that seed, salt and columns decide."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *of), F.lit(1 << 48)) / F.lit(float(1 << 48))).cast("double")


def pick(share: Column, entries: list[tuple[str, float]]) -> Column:
    """The entry in whose part of the cumulated weights a share falls."""
    total, upto = sum(w for _, w in entries), 0.0
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, weight in entries[:-1]:
        upto += weight / total
        out = out.when(share < upto, F.lit(label))
    return out.otherwise(F.lit(entries[-1][0]))


def generate(spark: SparkSession, n: int, *, seed: int = 7, start_ms: int = 1_750_000_000_000, reversal_share: float = 0.03, duplicate_share: float = 0.02, regions: tuple[tuple[str, float], ...] = (("EUSKADI", 4), ("MADRID", 3), ("CATALUNYA", 1))) -> DataFrame:
    """n placements with repeats and later reversals; the same rows for the same seed, on any cluster.

    Uids follow a power law over a pool of n / 10, stakes are log-normal (Box-Muller over hashes).  A
    repeat is the same event again; a reversal has its identity, a later version and ggr = turnover.
    """
    i, pool = F.col("id"), max(1000, n // 10)
    u = lambda salt: uniform(seed, salt, i)
    normal = F.sqrt(-2 * F.log(F.greatest(u("a"), F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * u("b"))
    turnover = F.round(F.least(F.greatest(F.exp(2.2 + 1.2 * normal), F.lit(0.5)), F.lit(5000.0)), 2)
    placed = F.lit(start_ms) + F.floor(u("t") * 30 * 86_400) * 1000
    kickoff = placed + F.floor((u("k") * 0.97 - 0.07) * 20_000) * 60_000
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    match = F.floor(u("m") * u("m2") * 450)
    market_name = pick(u("mk"), [("1X2", 5), ("Over/Under {goals}", 3), ("Shots {PLAYER}", 2), ("{COMPETITOR1}", 1)])
    currency = pick(u("c"), [("EUR", 0.88), ("PEN", 0.12)])
    rows = spark.range(n).select(
        i,
        F.floor(F.pow(u("u"), F.lit(2.6)) * pool).cast("string").alias("uid"), iso(placed).alias("placed_at"), iso(kickoff).alias("event_at"),
        pick(u("bt"), [("SIMPLE", 0.78), ("COMBINED", 0.22)]).alias("bet_type"), match.cast("long").alias("match_id"),
        F.concat(F.lit("Fixture "), match.cast("string")).alias("fixture"), F.concat(F.lit("League "), F.pmod(match, F.lit(56)).cast("string")).alias("competition"),
        market_name.alias("market"), F.concat(F.lit("Player "), F.floor(u("p") * 30).cast("string")).alias("player"),
        pick(u("s"), [("1", 4), ("X", 2), ("2", 3)]).alias("selection"), pick(u("r"), list(regions)).alias("region"),
        currency.alias("currency"), F.round(1.01 + F.pow(u("pr"), F.lit(3.0)) * 20, 3).alias("price"), turnover.alias("turnover"),
        F.round(F.when(u("w") < 0.45, -turnover * u("pr")).otherwise(turnover), 2).alias("ggr"),
        F.lit("placement").alias("event_kind"), F.lit("generator").alias("source"), (placed > kickoff).cast("int").alias("is_inplay"),
        F.round((placed - kickoff) / 60_000.0, 2).alias("minutes_to_kickoff"), (placed + 200).cast("long").alias("emitted_at"),
    ).withColumn("net_revenue", F.round(F.col("ggr") * 0.08, 2))
    again = rows.filter(u("dup") < duplicate_share)
    reversed_ = rows.filter(u("rev") < reversal_share).select(
        *[c for c in rows.columns if c not in ("ggr", "net_revenue", "event_kind", "emitted_at")],
        F.col("turnover").alias("ggr"), F.round(F.col("turnover") * 0.08, 2).alias("net_revenue"), F.lit("reversal").alias("event_kind"),
        (F.col("emitted_at") + 60_000 + F.floor(u("late") * 3_600_000).cast("long")).alias("emitted_at"),
    )
    names = [f.split()[0] for f in EVENT.split(", ")]
    return rows.unionByName(again).unionByName(reversed_).select(*names)


# ---- conveniences over any stream of timed events -------------------------------------------------


def windowed_counts(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and values by kind and window; later than `late` behind the newest is left out (streams only)."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size, slide) if slide else F.window("at", size), "event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")
    )


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
