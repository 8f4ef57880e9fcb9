"""The log clustered by identity.

A month's folder holds the folders of its batches, and each of these at most one file a bucket of row_key, sorted by it.
The current state is a collapse within buckets: no version of an identity is in another bucket, so reading needs no
exchange.  A compacted month has one file a bucket, whose order Spark takes as it is, without a sort.  Writing deals a
batch by row_key once.

The number of buckets is fixed when a log is made and is recorded in its folder.  The table's definition lives in the
session's catalog and is made again from the folder by whoever opens it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.legs import collapse
from ..sources.pruning import month_of, pruned

FOLDERS = ("placed_month", "batch")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _buckets(spark: SparkSession, path: str) -> int | None:
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [n.removeprefix("_buckets-") for n in names if n.startswith("_buckets-")]
    return int(found[0]) if found else None


def open_log(spark: SparkSession, path: str, *, schema=None, buckets: int = 64) -> str:
    """The name of the log's table; a log that isn't there is made for rows of a schema (a StructType)."""
    path, have = path.rstrip("/"), _buckets(spark, path)
    fs, at = _fs(spark, path)
    if have is None:
        if schema is None:
            raise FileNotFoundError(f"no clustered log at {path}")
        fs.mkdirs(at)
        fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(at, f"_buckets-{buckets}"))
        have = buckets
    name = "clustered_" + hashlib.md5(fs.makeQualified(at).toString().encode()).hexdigest()[:12]
    # a compacted month's files are taken as sorted
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    if not spark.catalog.tableExists(name):
        fields = schema if schema is not None else spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name not in FOLDERS)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, placed_month STRING, batch STRING) USING parquet OPTIONS (partitionOverwriteMode 'dynamic', compression 'zstd') "
            f"PARTITIONED BY (placed_month, batch) CLUSTERED BY (row_key) SORTED BY (row_key) INTO {have} BUCKETS LOCATION '{path}'"
        )
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    return name


def append(rows: DataFrame, path: str, *, batch: str | None = None, buckets: int = 64) -> None:
    """Append versions to the clustered log; a batch that is written again replaces itself in the months it has."""
    spark = rows.sparkSession
    plain = rows.drop(*FOLDERS)
    name = open_log(spark, path, schema=plain.schema, buckets=buckets)
    dealt = plain.withColumns({"placed_month": month_of(F.col("placed_at")), "batch": F.lit(batch or f"append-{uuid.uuid4().hex}")})
    columns = spark.table(name).columns
    dealt.repartition(_buckets(spark, path), "row_key").select(*columns).write.mode("overwrite").insertInto(name)


def read(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The log's versions, with placed_month; where is a condition on immutable columns, of which one on placed_at
    also prunes months."""
    return pruned(spark.table(open_log(spark, path)), where).drop("batch")


def current(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The current state, by a collapse within buckets."""
    return collapse(read(spark, path, where))


def compact(spark: SparkSession, path: str, month: str, *, batches: list[str] | None = None) -> None:
    """Rewrite a month's batches (all that it has, if none are named) as one, of current versions.

    The new batch appears by one rename before the old ones go, so a reader between sees some versions twice,
    which collapse alike, and never a hole.  Batches that appear meanwhile stay as they are.
    """
    name = open_log(spark, path)
    table = spark.table(name).filter(F.col("placed_month") == month)
    old = batches if batches is not None else [r["batch"] for r in table.select("batch").distinct().collect()]
    if not old:
        return
    now = collapse(table.filter(F.col("batch").isin(old)).drop(*FOLDERS))
    append(now, path, batch=f"compact-{uuid.uuid4().hex}")
    for batch in old:
        fs, at = _fs(spark, f"{path.rstrip('/')}/placed_month={month}/batch={batch}")
        fs.delete(at, True)
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
