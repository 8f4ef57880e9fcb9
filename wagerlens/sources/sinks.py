"""Where rows go: event lines, a keyed log, the versioned table, single files."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITIONS = 6


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON text a row, with null fields kept out."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def keyed(events: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Events dealt by Uid, so that one partition has all of a Uid's events in order; key and value for a log."""
    return events.repartition(partitions, "uid").select(F.col("uid").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_events(events: DataFrame, target: str, *, brokers: str = "", topic: str = "") -> None:
    """target: file:<folder> for lines, or kafka (needs the connector on the class path)."""
    if target.startswith("file:"):
        event_lines(events).write.mode("append").text(target.removeprefix("file:"))
    elif target == "kafka":
        keyed(events).write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()
    else:
        raise ValueError(f"unknown sink: {target!r}")


def append_log(legs: DataFrame, path: str, *, batch: str | None = None) -> None:
    """Append versions to the log, partitioned by the month of placed_at and by batch, sorted for its row groups'
    statistics.  A batch that is written again replaces itself."""
    rows = legs.withColumn("placed_month", F.date_format("placed_at", "yyyy-MM")).withColumn("batch", F.lit(batch or f"append-{uuid.uuid4().hex}"))
    writer = rows.sortWithinPartitions("placed_month", "placed_at", "row_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("placed_month", "batch").parquet(path)


def file_counts(table: DataFrame) -> DataFrame:
    """Files of each month of a log: what compaction would reduce."""
    return table.select("placed_month", F.col("_metadata.file_path").alias("file")).groupBy("placed_month").agg(F.countDistinct("file").alias("files"))


def compact_month(spark, path: str, month: str, collapse) -> None:
    """Rewrite one sealed month with the current version of each identity.

    The collapsed rows appear beside the old ones by one rename, and the old batches go afterwards.  A reader
    meanwhile, or after a crash between, sees some versions twice, which collapse to the same state; it never
    sees a hole.
    """
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(f"{path.rstrip('/')}/placed_month={month}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(folder)]
    name = f"batch=compact-{uuid.uuid4().hex}"
    aside = f"{path.rstrip('/')}/_compacting/{name}"
    collapse(spark.read.parquet(path).filter(F.col("placed_month") == month)).drop("placed_month", "batch").write.parquet(aside)
    if not fs.rename(files.Path(aside), files.Path(folder, name)):
        raise OSError(f"could not move {aside}")
    for batch in old:
        fs.delete(batch, True)


def write_json(value, path: str | Path, *, compact: bool = False) -> None:
    """A driver-side report: written beside its place, then renamed; no NaN or infinity."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(value, ensure_ascii=False, allow_nan=False, **({"separators": (",", ":")} if compact else {"indent": 2})) + "\n"
    handle, beside = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(beside, path)


def write_json_rows(rows: Iterable, path: str | Path) -> None:
    """A JSON array of any length, one value a line, that never stands whole in memory; renamed like write_json."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(rows):
            f.write((",\n" if i else "\n") + json.dumps(row, ensure_ascii=False, allow_nan=False))
        f.write("\n]\n")
    os.replace(beside, path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A whole table as CSV, in as many files as it has partitions; nothing for an empty table."""
    if not rows.isEmpty():
        rows.write.mode("overwrite").option("header", True).csv(path)
