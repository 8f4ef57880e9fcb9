"""Ranks and running sums over any number of values, and exact order statistics: no group meets in one task.

Values are dealt into ranges whose bounds come from a bounded sketch of each key's values; ranges are summed, and only
those sums (RANGES rows a key) are cumulated in one place.  Bounds decide how the work is split, never a result.
Order statistics are found by histograms: each pass counts the next DIGIT bits of the values that share the digits
found so far, so a pass shuffles 2^DIGIT rows a key and task at most, whatever it counts.

Both read their rows several times: hand them a table that is written, not a long plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
DIGIT = 12


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def running(rows: DataFrame, value: str, sums: list[str], keys: list[str]) -> DataFrame:
    """rows (one for each keys and value; no null value) with upto_<s>, the sum over values up to this one, and all_<s>."""
    names = [f"of_{i}" for i in range(len(keys))]
    of = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    marks = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], F.lit(10 * RANGES)).alias("marks")
    bounds = rows.groupBy(*of).agg(marks) if keys else rows.agg(marks)
    placed = rows.join(bounds, _same(keys, names)) if keys else rows.crossJoin(F.broadcast(bounds))  # without keys, one row
    placed = placed.withColumn("range", F.size(F.filter("marks", lambda b: b < F.col(value)))).select(*rows.columns, "range")
    parts = placed.groupBy(*of, F.col("range").alias("of_range")).agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*names).orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a key
    parts = parts.select(
        *names, "of_range",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"before_{s}") for s in sums], *[F.sum(s).over(Window.partitionBy(*names)).alias(f"all_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(parts, _same([*keys, "range"], [*names, "of_range"]))
    return joined.select(*rows.columns, *[(F.col(f"before_{s}") + F.sum(s).over(inside)).alias(f"upto_{s}") for s in sums], *[f"all_{s}" for s in sums])


def at_ranks(rows: DataFrame, value: str, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """ranks (keys, place from 0) with found: the value (a long) that stands at the place among those of its keys."""
    names = [f"of_{i}" for i in range(len(keys))]
    least = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    widest = least.agg(F.max(F.col("most").cast("decimal(20,0)") - F.col("least"))).first()[0]
    passes = max(1, -(-int(widest or 0).bit_length() // DIGIT))
    if passes * DIGIT > 63:
        raise ValueError("values of a key are further apart than 60 bits")
    based = rows.join(least.select(*names, "least"), _same(keys, names)).select(*keys, (F.col(value) - F.col("least")).alias("high"))
    wanted = ranks.select(*keys, "place").distinct().withColumns({"left": F.col("place"), "prefix": F.lit(0).cast("long")})
    for i in reversed(range(passes)):
        seen = wanted.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "place", "left", F.col("prefix").alias("of_prefix"))
        step = based.withColumns({"prefix_of": F.shiftright("high", DIGIT * (i + 1)), "digit": F.shiftright("high", DIGIT * i).bitwiseAND(F.lit((1 << DIGIT) - 1))})
        # each pass names the one before once, so plans grow by a step a pass
        found = step.join(seen, _same([*keys, "prefix_of"], [*names, "of_prefix"])).groupBy(*keys, "place", "left", F.col("of_prefix").alias("prefix"), "digit").agg(F.count("*").alias("n"))
        upto = Window.partitionBy(*keys, "place").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)  # 2^DIGIT rows a place
        found = found.withColumn("upto", F.sum("n").over(upto)).filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        wanted = found.select(*keys, "place", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix"))
    return wanted.join(least, _same(keys, names)).select(*keys, "place", (F.col("prefix") + F.col("least")).alias("found"))


def quantile(rows: DataFrame, value: str, q: float, keys: list[str], *, scale: float = 1.0) -> DataFrame:
    """Per keys: n, low and high (the longs around the quantile) and result, between them linearly and over scale."""
    named = {k: f"k_{i}" for i, k in enumerate(keys)}
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n")).filter("n > 0").withColumn("at", (F.col("n") - 1) * F.lit(q))
    sizes = sizes.withColumns({"lower": F.floor("at"), "upper": F.ceil("at")})
    places = sizes.select(*keys, F.explode(F.array("lower", "upper")).alias("place")).distinct()
    found = at_ranks(rows.filter(F.col(value).isNotNull()), value, places, keys).withColumnsRenamed(named)
    joined = sizes.join(found, _same([*keys], [*named.values()]) & F.col("place").between(F.col("lower"), F.col("upper")))
    ends = joined.groupBy(*keys, "n", "at", "lower", "upper").agg(F.min("found").alias("low"), F.max("found").alias("high"))
    low, high = F.col("low") / F.lit(float(scale)), F.col("high") / F.lit(float(scale))
    between = F.when(F.col("low") == F.col("high"), low).otherwise((F.col("upper") - F.col("at")) * low + (F.col("at") - F.col("lower")) * high)
    return ends.select(*keys, "n", "low", "high", between.alias("result"))
