"""Tables that are derived once and read many times, as Parquet in the folder that the cluster shares.

Facts are canonicalised when they come in, so that no reader derives them again: enriched legs, betslips
and priced legs are staged by their inputs.  A staged table is found again in the same application while
its input files are the same (names, sizes and times); a changed input makes a new one.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple, tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the cluster names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.wagerlens.scratch", None)
        if not folder:
            own = tempfile.mkdtemp(prefix="wagerlens-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            folder = f"file://{own}"
            spark.conf.set("spark.wagerlens.scratch", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under paths: names, sizes and times, as the file system lists them."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            file = files.next()
            found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


#: Spark's setting that deletes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: its readers read the table, and else they would stay on disk."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder once and read back: its readers don't derive it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def known(spark: SparkSession, name: str, inputs: list[str]) -> bool:
    """Whether this application has staged the table of these inputs as they are."""
    return (spark.sparkContext.applicationId, name, *inputs, state_of(spark, inputs)) in _known


def staged(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], *, cluster_by: str | None = None) -> DataFrame:
    """The table that build makes of the inputs; cluster_by deals its rows by a key and sorts them within files."""
    key = (spark.sparkContext.applicationId, name, *inputs, state_of(spark, inputs))
    if key in _known:
        path, schema = _known[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # its folder was cleared meanwhile
            del _known[key]
    path = f"{shared_folder(spark).rstrip('/')}/staged-{name}-{uuid.uuid4().hex}"
    df = build()
    if cluster_by:
        df = df.repartition(cluster_by).sortWithinPartitions(cluster_by)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    _known[key] = (path, df.schema)
    return spark.read.schema(df.schema).parquet(path)
