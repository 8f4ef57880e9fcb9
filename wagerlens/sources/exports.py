"""Billing exports as legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import minutes_between, parse_export_time, version_of_file
from .standin import row_key

#: Columns of an export and the engine's names.
COLUMNS = {
    "Sport": "sport",
    "Competition": "competition",
    "MatchId": "match_id",
    "MATCH": "fixture",
    "Event date (utc)": "event_at",
    "Market": "market",
    "BetType": "bet_type",
    "Player": "player",
    "Option": "selection",
    "Betslip date (utc)": "placed_at",
    "Uid": "uid",
    "Management unit": "management_unit",
    "Price": "price",
    "TURNOVER": "turnover",
    "GGR": "ggr",
    "Net Revenue": "net_revenue",
    "Currency Code": "currency",
}


def read_exports(spark: SparkSession, paths: str | list[str], *, fmt: str = "csv", **options) -> DataFrame:
    """All files of a glob, every column as text first: Uids never become numbers.  No file is an error.

    Adds source_file and version (from the stamp in the file's name).  Other formats (xlsx through a data
    source, if one is installed) go by fmt.
    """
    text = ", ".join(f"`{c}` string" for c in COLUMNS)
    reader = spark.read.format(fmt).schema(text).options(**({"header": True} | options))
    raw = reader.load(paths)
    tagged = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    empty = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    cast = {"match_id": "long", "price": "decimal(10,3)", "turnover": "decimal(18,2)", "ggr": "decimal(18,2)", "net_revenue": "decimal(18,2)"}
    columns = []
    for theirs, ours in COLUMNS.items():
        column = empty(theirs)
        if ours.endswith("_at"):
            column = parse_export_time(column)
        elif ours in cast:
            column = column.try_cast(cast[ours])
        columns.append(column.alias(ours))
    rows = tagged.select(*columns, "source_file").withColumn("version", version_of_file(F.col("source_file")))
    return rows.withColumn("row_key", row_key(rows))


def to_events(legs: DataFrame) -> DataFrame:
    """Legs as wire events; legs without a time are left out, an unknown kick-off is the bet's time."""
    rows = legs.filter(F.col("placed_at").isNotNull()).withColumn("event_at", F.coalesce("event_at", "placed_at"))
    minutes = minutes_between(F.col("placed_at"), F.col("event_at"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
    return rows.select(
        "uid", iso("placed_at"), iso("event_at"), "bet_type", "match_id", "fixture", "competition", "market", "player", "selection",
        F.col("management_unit").alias("region"), "currency", F.col("price").cast("double"), F.col("turnover").cast("double"), F.col("ggr").cast("double"),
        F.col("net_revenue").cast("double"), F.lit("placement").alias("event_kind"), F.lit("export").alias("source"),
        (minutes > 0).cast("int").alias("is_inplay"), F.round(minutes, 2).alias("minutes_to_kickoff"), F.col("version").alias("emitted_at"),
    )
