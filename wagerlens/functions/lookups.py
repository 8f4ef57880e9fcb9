"""Small values by whole-number keys, and sets of hashes, as dense arrays that are broadcast: large tables needn't be dealt to meet them.

A table of few different values (names of nations, kinds of parts) becomes two bytes a key.  A set of hashes becomes a
bitmap of 16 bits a value: it keeps all rows whose hash is in the set, and a few others, so what it keeps is decided exactly
afterwards and never by it alone.  Both are bounded; a larger table is joined as tables are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.staged import written

#: Values of one array, most keys of a table that is broadcast (64 MB), and most kinds of values.
SLOTS, MOST_KEYS, MOST_KINDS = 4096, 1 << 25, 4096
#: Bits of one array of a bitmap, and most bits of one (32 MB): more values make it keep more rows than it must.
WORD_BITS, MOST_BITS = 64 * SLOTS, 1 << 28
#: Rows of a slice, until there are MOST_SLICES.
SLICE_ROWS, MOST_SLICES = 3_000_000, 8


def dense(values: DataFrame, kind: str) -> DataFrame:
    """(bucket, held): values (key, value; whole numbers) by bucket of SLOTS keys, 0 where there is none."""
    placed = values.select(F.shiftright("key", 12).alias("bucket"), F.col("key").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"), F.col("value").cast(kind).alias("value"))
    empty = placed.select("bucket").distinct().select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"), F.lit(0).cast(kind).alias("value"))
    whole = placed.unionByName(empty).groupBy("bucket", "slot").agg(F.bit_or("value").alias("value"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: x["value"])
    return whole.groupBy("bucket").agg(held.alias("held"))


@dataclass(frozen=True)
class Lookup:
    """A table of few different values by whole-number keys that don't repeat: codes by key, and each code's values."""

    held: DataFrame
    kinds: list
    fields: list

    def values(self, code: str) -> dict[str, Column]:
        """Each column's value by code: an array of one column's values is one literal."""
        return {f.name: F.get(F.array(*[F.lit(r[f.name]).cast(f.dataType) for r in self.kinds]), F.col(code) - 1) for f in self.fields}


def lookup(table: DataFrame, key: str, columns: list[str]) -> Lookup | None:
    """None for a table whose keys repeat, or that is too large, too sparse or has too many different values."""
    spark, known = table.sparkSession, table.select(F.col(key).cast("long").alias("key"), F.struct(*columns).alias("kind")).filter("key IS NOT NULL")
    keys = known.groupBy("key").agg(F.count("*").alias("times"), F.min("kind").alias("kind"))
    kinds = keys.groupBy("kind").agg(F.count("*").alias("n"), F.max("times").alias("times"), F.min("key").alias("low"), F.max("key").alias("high")).limit(MOST_KINDS + 1).collect()
    n = sum(r["n"] for r in kinds)
    if not 0 < len(kinds) <= MOST_KINDS or n > MOST_KEYS or max(r["times"] for r in kinds) > 1 or max(r["high"] for r in kinds) - min(r["low"] for r in kinds) > 4 * n + SLOTS:
        return None
    kind = known.schema["kind"].dataType
    numbers = spark.createDataFrame([(i + 1, r["kind"]) for i, r in enumerate(kinds)], StructType([StructField("value", IntegerType()), StructField("of_kind", kind)]))
    held = written(dense(known.join(F.broadcast(numbers), F.col("kind").eqNullSafe(F.col("of_kind"))).select("key", "value"), "smallint"))
    return Lookup(held, [r["kind"] for r in kinds], kind.fields)


def looked_up(rows: DataFrame, key: str, found: Lookup, code: str) -> DataFrame:
    """rows that have a value, with its code: what a join on the key would keep."""
    at = F.col(key).cast("long")
    coded = rows.join(F.broadcast(found.held), F.shiftright(at, 12) == F.col("bucket"))
    coded = coded.select(*[F.col(f"`{c}`") for c in rows.columns], F.get("held", at.bitwiseAND(F.lit(SLOTS - 1)).cast("int")).alias(code))
    return coded.filter(F.col(code) > 0)


def several(rows: DataFrame, value: list, least: int = 2) -> DataFrame:
    """(h): hashes of a value (columns) that `least` rows have at least, written.  Rows of equal values have equal hashes."""
    counts = rows.select(F.xxhash64(*value).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return written(counts.filter(F.col("n") >= least).select("h"))


def hashes(rows: DataFrame, value: list) -> DataFrame:
    """(h): the different hashes of a value, written."""
    return written(rows.select(F.xxhash64(*value).alias("h")).distinct())


def bitmap(values: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of hashes (h), and its number of bits."""
    bits = min(MOST_BITS, max(WORD_BITS, 1 << (16 * values.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return dense(values.select(F.shiftright(at, 6).alias("key"), one.alias("bit")).groupBy("key").agg(F.bit_or("bit").alias("value")), "bigint"), bits


def sieved(rows: DataFrame, value: list, within: tuple[DataFrame, int], *, inside: bool = True) -> DataFrame:
    """The rows whose value's hash the bitmap has: all that are in the set, and a few more; or else all the others."""
    held, bits = within
    probed = rows.withColumn("probe_at", F.xxhash64(*value).bitwiseAND(F.lit(bits - 1)))
    word = F.get("held", F.shiftright("probe_at", 6).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))
    there = F.getbit(word, F.col("probe_at").bitwiseAND(F.lit(63)).cast("int")) == 1
    same = F.shiftright("probe_at", 18) == F.col("bucket")
    out = probed.join(F.broadcast(held), same, "inner" if inside else "left")
    return out.filter(there if inside else ~F.coalesce(there, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns])


def in_slices(rows: DataFrame, key: str, make: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], *, wide: int = 1) -> DataFrame:
    """What make gives for each slice of the key's values, one after the other, each written: what a slice shuffles is gone
    before the next begins.  make gets a function that keeps a table's rows of the slice; rows (written) say how many slices;
    wide: how many common rows one of them shuffles like."""
    n = min(MOST_SLICES, 1 + rows.count() * wide // SLICE_ROWS)
    parts = []
    for k in range(n):
        parts.append(written(make((lambda df, k=k: df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)) if n > 1 else (lambda df: df))))
    return reduce(DataFrame.unionByName, parts)
