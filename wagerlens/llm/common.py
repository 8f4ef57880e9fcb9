"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staged import shared_folder

#: Words of a text as the contracts define them: runs without ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: What stands between words once A-Z are lower-cased: ASCII other than digits and letters.
BREAK_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same folding on UTF-8 bytes: A-Z to a-z, breaks to a space, bytes of other code points stay.
FOLD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let Arrow batches to Python workers end at `limit` bytes: 10,000 long texts would not fit a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name)
    if not have.isdigit() or int(have) > limit:
        spark.conf.set(name, str(limit))


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: Bits of one row of a bitmap, as bitmap_construct_agg makes them, and most rows of one that is broadcast (8 MB).
ROW_BITS, MOST_ROWS = 32768, 2048


def bitmap_rows(n: int) -> int:
    """Rows of a bitmap of 16 bits for each of n values."""
    return n * 16 // ROW_BITS + 1


def _slot(value: Column, rows: int) -> tuple[Column, Column]:
    """A value's row in a bitmap of so many rows, and its bit there."""
    h = F.pmod(F.xxhash64(value), F.lit(rows * ROW_BITS))
    return F.shiftright(h, 15), h.bitwiseAND(F.lit(ROW_BITS - 1))


def bitmap_of(values: DataFrame, column: str, rows: int) -> DataFrame:
    """(slot, bits): a bitmap of the values' hashes, ROW_BITS bits a row."""
    slot, bit = _slot(F.col(column), rows)
    return values.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))


def in_bitmap(df: DataFrame, column: str, bits: DataFrame, rows: int) -> DataFrame:
    """The rows of df whose value a bitmap may have; those left out are not among what it was built of."""
    slot, bit = _slot(F.col(column), rows)
    probed = df.withColumn("probe_slot", slot).withColumn("probe_bit", bit.cast("int"))
    byte = F.conv(F.hex(F.expr("substring(bits, probe_bit DIV 8 + 1, 1)")), 16, 10).cast("long")
    found = probed.join(bits, (F.col("probe_slot") == F.col("slot")) & (F.getbit(byte, F.expr("probe_bit % 8")) == 1))
    return found.select(*[F.col(f"`{c}`") for c in df.columns])


def whole_rows(df: DataFrame, *keys: Column) -> DataFrame:
    """df's rows as one struct, row, beside keys: no column of df can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *keys)


def whole_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns (but maps): orders rows that an operator's own columns don't tell apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def numbered(rows: DataFrame, keys: list[str], place: str, name: str) -> DataFrame:
    """Adds name: rows of equal keys numbered from 0 in order of place (monotonically_increasing_id).

    No key meets in one task: rows are numbered within their input split, and added to what the splits
    before have.  rows are read from a written table.
    """
    split = F.shiftright(place, 33)
    several = rows.withColumn("its_split", split)
    counts = several.groupBy(*keys, "its_split").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("its_split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    offsets = counts.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("its_split").alias("of_split"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    same = F.col("its_split") == F.col("of_split")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    local = Window.partitionBy(*keys, "its_split").orderBy(place)
    joined = several.withColumn("in_split", F.row_number().over(local) - 1).join(offsets, same)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("offset") + F.col("in_split")).alias(name))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_bytes(value) -> bytes:
    """UTF-8 bytes of an Arrow string or binary scalar; null is empty."""
    raw = value.as_py() if hasattr(value, "as_py") else value
    return b"" if raw is None else raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw
