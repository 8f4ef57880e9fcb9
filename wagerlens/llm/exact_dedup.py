"""Exact deduplication through a log-structured merge index of text digests.

A document's digest is the SHA-256 of its text with every run of ASCII white space made one space.
Digests first go to a log table, whose input splits are taken into batches of at most `memtable_rows` rows
for each parallel task.  A batch is a memtable: one entry a digest, (smallest document, count), combined
before and after a shuffle.  It is flushed as a run, Parquet files sorted by digest, with a filter, a bitmap of
16 bits an entry in rows of 4 KB.  Before, its digests are probed against all older runs: only those whose bit
is set in a run's filter are looked up there.  `fanout` runs of a level are compacted to one of the next, in
which the smallest identifier of a digest survives.

Digests that a probe finds, or that a memtable has more than once, are hits.  Only hits are merged across
runs, and only hits receive byte verification: the smallest and the largest normalised text of a digest must
be the same bytes.  The texts that travel for it are those whose bit is set in a filter of the hits.

A group of copies never meets in one task: every step combines rows of a digest before its shuffle.

Defined results: null text counts as empty; a null doc_id ranks after all others; of rows with the same
doc_id and text, ties and repeated rows, the first of the log stays; very long texts are digested and compared
whole; an empty table gives an empty result; two texts with one digest would raise an error rather than lose
a text; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_ROWS, SPACE_CLASS, bitmap_of, bitmap_rows, in_bitmap, keep

def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def _rank() -> Column:
    """Orders documents by doc_id, nulls last, and rows of one doc_id by their place in the log."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


@dataclass(frozen=True)
class Run:
    """Entries (digest, best, n) sorted by digest, and their filter."""

    entries: DataFrame
    bits: DataFrame
    rows: int  # of the filter


class DigestIndex:
    """Levels of sorted runs in the shared folder; best is the smallest document of a digest."""

    def __init__(self, spark: SparkSession, *, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def _flush(self, entries: DataFrame, level: int) -> None:
        run = keep(entries.sortWithinPartitions("digest"))
        rows = bitmap_rows(run.count())
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Run(run, keep(bitmap_of(run, "digest", rows)), rows))

    def insert(self, rows: DataFrame) -> DataFrame:
        """Take a memtable, rows of (doc_id, row, digest); returns its digests that are hits."""
        older = self.runs()
        self._flush(rows.groupBy("digest").agg(F.min(_rank()).alias("best"), F.count("*").alias("n")), 0)
        new = self.levels[0][-1].entries
        hits = [new.filter("n > 1").select("digest")]
        for run in older:
            maybe = in_bitmap(new.select("digest"), "digest", run.bits, run.rows)
            hits.append(maybe.join(run.entries.select("digest"), "digest", "left_semi"))
        found = keep(reduce(DataFrame.unionByName, hits))
        self._compact()
        return found

    def _compact(self) -> None:
        """Merge the runs of every level that has `fanout` of them into one of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                several = self.levels[level]
                self.levels[level] = []
                self._flush(self._merged([r.entries for r in several]), level + 1)
            level += 1

    @staticmethod
    def _merged(entries: list[DataFrame]) -> DataFrame:
        together = reduce(DataFrame.unionByName, entries)
        return together.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))

    def groups(self, hits: DataFrame) -> DataFrame:
        """(digest, best, n) of the digests that are hits, over all runs."""
        return self._merged([run.entries.join(hits, "digest", "left_semi") for run in self.runs()])


def verified(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per digest that is a hit, whether all its texts are the same bytes."""
    rows = min(bitmap_rows(hits.count()), MOST_ROWS)
    bits = F.broadcast(keep(bitmap_of(hits, "digest", rows)))  # MOST_ROWS rows of 4 KB at most
    text = docs.select(normalised(F.col("text")).alias("norm"))
    text = in_bitmap(text.select(F.unhex(F.sha2("norm", 256)).alias("digest"), "norm"), "digest", bits, rows)
    return text.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))


def _batches(log: DataFrame, most: int) -> list[Column]:
    """Conditions on row that take whole splits of the log, as many as have `most` rows together, or one."""
    split = F.shiftright("row", 33)
    sizes = sorted((r["split"], r["n"]) for r in log.groupBy(split.alias("split")).agg(F.count("*").alias("n")).collect())  # a row a split
    out, first, rows = [], None, 0
    for number, n in sizes:
        if first is not None and rows + n > most:
            out.append(F.col("row").between(first << 33, (number << 33) - 1))
            first, rows = None, 0
        first, rows = number if first is None else first, rows + n
    return [*out, F.col("row") >= ((first or 0) << 33)]


def exact_dedup(docs: DataFrame, *, memtable_rows: int = 16_384, fanout: int = 4) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes (of the normalised text)."""
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    log = keep(
        docs.select("doc_id", norm.alias("norm")).select(
            "doc_id",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.octet_length("norm").cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    index = DigestIndex(spark, fanout=fanout)
    found = [index.insert(log.filter(batch).select("doc_id", "row", "digest")) for batch in _batches(log, memtable_rows * spark.sparkContext.defaultParallelism)]
    hits = keep(reduce(DataFrame.unionByName, found).distinct())
    groups = index.groups(hits)
    checked = groups.join(verified(docs, hits), "digest", "left").select(
        "digest",
        "n",
        F.when(F.coalesce("same", F.lit(False)), F.col("best"))
        .otherwise(F.raise_error(F.lit("two texts share one SHA-256 digest")).cast(groups.schema["best"].dataType))
        .alias("best"),
    )
    # written: log and groups are plain shuffles of the join, of which Spark splits a large group of copies
    joined = log.join(keep(checked), "digest", "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    )
