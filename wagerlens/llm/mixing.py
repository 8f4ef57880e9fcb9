"""Mixing sources to target weights by nested hash thresholds.

Targets are filled like water: all sources share the wanted total by weight, a source stops at `cap`
times its size, and the excess is shared again by weight among the rest.  A source then gives all its
documents a whole number of times, and the remainder from the documents below a hash threshold.  The
threshold comes from a histogram of sizes by source and hash bucket (4,096 of a 48-bit hash of doc_id and
text): the budget ends in one bucket, the boundary, and only that bucket's documents are summed hash by hash.
The final filter compares each document's hash with its source's threshold, so nothing is sorted, and a
larger budget always takes a superset.

The budget ends within the rows of one hash, the edge: rows of equal doc_id and text, which are numbered in
the table's order, and of which as many are taken as come nearest to the target.  So a source's sum is off by
at most half of one document, whatever repeats.

Defined results: null text has size 0; null source is a source, ranked last; null doc_id hashes as an
empty id; ties and repeated rows are taken alike but at the edge; very long texts are one document each; with
no words all targets are 0; an empty table gives an empty result; further columns, whatever their names, are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, numbered, whole_hash, whole_rows, word_count

BUCKET_BITS, HASH_BITS = 12, 48


def hash48(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of the MD5 of the id as text, a separator and the text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(by_source: DataFrame, *, total: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """From (source, source_size): adds target.  Its windows see one row a source."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "level",
        (F.lit(total) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.least("most", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _dealt(rows: DataFrame, thresholds: DataFrame, source: str) -> DataFrame:
    """Adds source_size, target and copies to rows with a source, h, place and tie.

    Rows at their source's edge are written and numbered; all others are compared with it.
    """
    dealt = rows.join(thresholds, F.col(source).eqNullSafe(F.col("of")))
    below = dealt.filter(F.col("h") != F.col("edge")).withColumn("extra", F.col("h") < F.col("edge"))
    at = numbered(keep(dealt.filter(F.col("h") == F.col("edge"))), ["of", "tie"], "place", "number")
    before = Window.partitionBy("of").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)  # a row a kind of equal rows
    kinds = at.groupBy("of", "tie").agg(F.count("*").alias("n")).select(F.col("of").alias("kind_of"), F.col("tie").alias("kind"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = at.join(kinds, F.col("of").eqNullSafe(F.col("kind_of")) & (F.col("tie") == F.col("kind"))).withColumn("extra", F.col("first") + F.col("number") < F.col("edge_rows"))
    together = below.unionByName(at.select(*below.columns))
    return together.withColumn("copies", F.col("whole") + F.when(F.col("extra"), 1).otherwise(0))


def mix(docs: DataFrame, *, total: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, source, copies (taken = copies x size)."""
    h = hash48(F.col("doc_id"), F.col("text")).alias("h")
    sized = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h, F.monotonically_increasing_id().alias("place"), F.lit(0).alias("tie")))
    out = _dealt(sized, _small(_thresholds(sized, total, cap, weights)), "source")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", F.col("copies").cast("long").alias("copies"))


def mixed_docs(docs: DataFrame, *, total: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with their columns unchanged."""
    h = hash48(F.col("doc_id"), F.col("text")).alias("h")
    sized = keep(docs.select("source", word_count(F.col("text")).alias("size"), h))
    rows = whole_rows(docs, h, F.monotonically_increasing_id().alias("place"), whole_hash(docs).alias("tie"))
    out = _dealt(rows, _small(_thresholds(sized, total, cap, weights)), "row.source")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def _small(thresholds: DataFrame, most: int = 100_000) -> DataFrame:
    """The sources' thresholds, to be broadcast if their number is at most `most`, else joined by a shuffle."""
    kept = keep(thresholds)
    return F.broadcast(kept) if kept.count() <= most else kept


def _thresholds(sized: DataFrame, total: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Per source (of): source_size, target, whole (times all is taken), edge (hashes below are taken once more),
    edge_rows (as many rows of that hash too)."""
    shift = HASH_BITS - BUCKET_BITS
    buckets = sized.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
    budget = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), total=total, cap=cap, weights=weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = budget.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    budget = keep(budget)

    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = buckets.withColumn("sum", F.sum("n").over(upto)).alias("b")
    boundary = (
        summed.join(budget.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .filter((F.col("b.sum") > F.col("s.rest")) & (F.col("b.sum") - F.col("b.n") <= F.col("s.rest")))
        .groupBy(F.col("b.source").alias("source"), F.col("s.rest").alias("rest"))
        .agg(F.min("b.bucket").alias("bucket"), F.min(F.col("b.sum") - F.col("b.n")).alias("base"))
    )
    boundary = keep(boundary)

    inside = (
        sized.alias("d")
        .join(
            boundary.alias("e"),
            F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright("d.h", shift) == F.col("e.bucket")),
        )
        .groupBy(F.col("e.source").alias("source"), "e.bucket", "e.base", "e.rest", F.col("d.h").alias("h"))
        .agg(F.sum("d.size").alias("n"), F.count("*").alias("rows"))
    )
    upto = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.col("base") + F.sum("n").over(upto)).filter(F.col("sum") > F.col("rest"))
    left = F.col("rest") - (F.col("sum") - F.col("n"))
    each = F.col("n") / F.col("rows")
    ends = inside.groupBy("source").agg(F.min_by(F.struct(F.col("h").alias("edge"), F.ceil(left / each - 0.5).cast("long").alias("edge_rows")), "h").alias("end")).alias("c")
    every, none = F.lit(1 << HASH_BITS), F.lit(-1)
    return budget.alias("a").join(ends, F.col("a.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("a.source").alias("of"),
        "source_size",
        "target",
        "whole",
        F.when(F.col("rest") <= 0, none).otherwise(F.coalesce("c.end.edge", every)).alias("edge"),
        F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce("c.end.edge_rows", F.lit(0))).alias("edge_rows"),
    )


#: The same rows by one sort of all documents, in DuckDB's SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most
  FROM sources),
levels AS (
  SELECT *, most / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN level <= full_at THEN level END) OVER (), 0) * weight) AS target FROM levels),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM aimed),
ranked AS (
  SELECT s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN rest > 0 AND (size = 0 AND before <= rest OR size > 0 AND rest - before > size / 2.0) THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM ranked
"""
