"""Ranked breakdowns: the N most frequent keys, the rest as one row, money by currency beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUILDER_MARKETS, DEFAULTS, OUTCOME_NAMES
from ..functions.stats import ratio4
from . import money

OTHER, NULL = "__other__", "__null__"
#: Buckets in a word of bits, and most counters of one aggregation (its code is compiled as one).
WORD, COUNTERS = 62, 64


def top_keys(frame: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys: count, then key ascending.  A top-k, not a sort of all keys."""
    return frame.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(n)


def breakdown(frame: DataFrame, key: str, *, top_n: int = DEFAULTS.top_n, label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, money): counts has key, label, legs, share, betslips; money has key, currency, amount.

    Ranks by count, as money can't be ordered across currencies.  A null key is a key.  The top_n keys are found first
    (a job of its own, whose top_n rows become part of the plan); then every row knows its bucket where it is read, and
    sums and betslips combine by bucket before any shuffle.
    """
    currency = F.when(money.known(F.col("currency")), F.col("currency"))
    heads = [r["text"] for r in top_keys(frame, key, top_n).select(_text(F.col(key)).alias("text")).collect()]
    place = _place(_text(F.col(key)), heads)
    # labels as keys, of which the least is taken afterwards: the least text of a group doesn't fit a hash aggregation
    shown = F.when(place < len(heads), label.cast("string")) if label is not None else F.lit(None).cast("string")
    summed = frame.groupBy(place.alias("place"), currency.alias("currency"), shown.alias("label")).agg(F.count("*").alias("legs"), F.sum("turnover").alias("amount"))
    bucket = _bucket(F.col("place"), heads)
    counts = summed.groupBy("place").agg(F.sum("legs").alias("legs"), F.min("label").alias("label"))
    slips = betslips_in(frame.select("betslip_id", place.alias("p0")), 1, len(heads))
    counts = counts.join(F.broadcast(slips.select(F.col("place").alias("of_place"), "betslips")), F.col("place") == F.col("of_place"))  # a row a bucket
    total = F.sum("legs").over(Window.partitionBy())
    counts = counts.select(bucket.alias("key"), F.coalesce("label", bucket).alias("label"), "legs", ratio4(F.col("legs"), total).alias("share"), "betslips")
    return counts, summed.groupBy("place", "currency").agg(F.sum("amount").alias("amount")).select(bucket.alias("key"), "currency", "amount")


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL))


def _place(text: Column, heads: list[str]) -> Column:
    """A key's place among the heads; their number for all others."""
    known = F.array(*map(F.lit, heads)).cast("array<string>")
    return F.coalesce(F.nullif(F.array_position(known, text), F.lit(0)) - 1, F.lit(len(heads))).cast("int")


def _bucket(place: Column, heads: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, heads)).cast("array<string>"), place), F.lit(OTHER))


def betslips_in(rows: DataFrame, dimensions: int, most: int) -> DataFrame:
    """(d, place, betslips): exact counts of betslips by bucket, of all dimensions at once.

    rows: betslip_id and p0, p1 ..., the place (0 to most) of the bucket in each dimension.  A bucket is a bit; a betslip's
    bits are an OR over its legs, which combines before its shuffle, and every bit has a counter: no leg is multiplied, and no
    pair of bucket and betslip is kept.
    """
    words = most // WORD + 1
    bit = lambda p, w: F.when(p.between(w * WORD, w * WORD + WORD - 1), F.call_function("shiftleft", F.lit(1).cast("long"), p - w * WORD)).otherwise(F.lit(0).cast("long"))
    pairs = [(d, w) for d in range(dimensions) for w in range(words)]
    bits = rows.groupBy("betslip_id").agg(*[F.bit_or(bit(F.col(f"p{d}"), w)).alias(f"b{d}_{w}") for d, w in pairs])
    if dimensions * (most + 1) <= COUNTERS:  # a counter for each bucket, in one row
        buckets = [(d, place) for d in range(dimensions) for place in range(most + 1)]
        totals = bits.agg(*[F.sum(F.getbit(f"b{d}_{place // WORD}", F.lit(place % WORD)).cast("long")).alias(f"n{d}_{place}") for d, place in buckets])
        entries = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(place).alias("place"), F.col(f"n{d}_{place}").alias("betslips")) for d, place in buckets])
        return totals.select(F.explode(entries).alias("e")).select("e.*").filter("betslips > 0")
    # else betslips are counted by the bits they have, of which there are few kinds
    words_of = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w"), F.col(f"b{d}_{w}").alias("bits")) for d, w in pairs])
    kinds = bits.select(F.explode(words_of).alias("e")).select("e.*").filter("bits <> 0").groupBy("d", "w", "bits").agg(F.count("*").alias("n"))
    found = kinds.select("d", "w", "n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1)).alias("b"))
    return found.groupBy("d", (F.col("w") * WORD + F.col("b")).alias("place")).agg(F.sum("n").alias("betslips"))


def dealt(rows: DataFrame, column: str, head: DataFrame) -> DataFrame:
    """rows with the bucket of a key: its own for one of the head, else the rest's."""
    return rows.join(head, F.col(column).eqNullSafe(F.col("head_key")), "left").withColumn("bucket", F.coalesce("head_bucket", F.lit(OTHER)))


def ranked(summed: DataFrame, betslips_of: Callable[[DataFrame], DataFrame], *, top_n: int = DEFAULTS.top_n) -> tuple[DataFrame, DataFrame]:
    """A breakdown from sums by key and currency (of_key, currency, legs, amount, label).

    betslips_of takes the head (head_key, head_bucket; at most top_n rows, broadcast) and counts bucket, betslips.
    """
    per_key = summed.groupBy("of_key").agg(F.sum("legs").alias("legs"), F.min("label").alias("label"))
    head = per_key.orderBy(F.desc("legs"), F.asc_nulls_last("of_key")).limit(top_n)
    head = F.broadcast(head.select(F.col("of_key").alias("head_key"), F.coalesce(F.col("of_key").cast("string"), F.lit(NULL)).alias("head_bucket")))
    counts = dealt(per_key, "of_key", head).groupBy("bucket").agg(F.sum("legs").alias("legs"), F.min(F.when(F.col("bucket") != OTHER, F.col("label"))).alias("label"))
    total = per_key.agg(F.sum("legs").alias("total"))
    counts = counts.join(F.broadcast(betslips_of(head)), "bucket").crossJoin(F.broadcast(total)).select(  # top_n + 1 rows, and one row
        F.col("bucket").alias("key"), F.coalesce("label", "bucket").alias("label"), "legs", ratio4(F.col("legs"), F.col("total")).alias("share"), "betslips"
    )
    sums = dealt(summed, "of_key", head).groupBy("bucket", "currency").agg(F.sum("amount").alias("amount")).select(F.col("bucket").alias("key"), "currency", "amount")
    return counts, sums


def flat(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Counts beside each currency's amount; null currency is the unresolved amount."""
    counts, sums = parts
    return counts.join(sums, "key").withColumn("turnover", F.col("amount").cast("double")).drop("amount")


def busiest_markets(legs: DataFrame, n: int) -> DataFrame:
    pool = legs.filter(~F.col("market_normalised").isin(*BUILDER_MARKETS.values()))
    return top_keys(pool, "market_normalised", n).select("market_normalised")


def selections(legs: DataFrame, *, markets: int = DEFAULTS.selection_markets) -> DataFrame:
    """Legs of the busiest markets that are no bet builders, with selection_key and selection_label.

    The label names the player only where a market has several.
    """
    return labelled(legs.join(F.broadcast(busiest_markets(legs, markets)), "market_normalised", "left_semi"))


def labelled(scoped: DataFrame) -> DataFrame:
    """Adds selection_key and selection_label to rows of a few markets."""
    players = scoped.groupBy("market_normalised").agg(F.countDistinct("player").alias("n_players"))
    shown = F.col("selection")
    for token, name in OUTCOME_NAMES.items():
        shown = F.when(F.col("selection") == token, name).otherwise(shown)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return scoped.join(F.broadcast(players), "market_normalised").select(  # a row for each of `markets`
        *scoped.columns,
        F.concat_ws("|", text("market_normalised"), text("player"), text("selection")).alias("selection_key"),
        F.when(F.col("n_players") > 1, F.concat(text("player"), F.lit(" - "), shown)).otherwise(shown).alias("selection_label"),
    )


#: Breakdowns by their dimension: (key column, label column).
LEG_DIMENSIONS = {
    "by_market": ("market_normalised", None),
    "by_competition": ("competition", None),
    "by_fixture": ("match_id", "fixture"),
}
SLIP_DIMENSIONS = {"by_region": ("region", None), "by_bet_type": ("bet_type", None)}

#: All dimensions of a leg: its own, and those of its betslip.
DIMENSIONS = {"market_normalised": None, "competition": None, "match_id": "fixture", "region": None, "bet_type": None, "player": None, "selection": None}


def single_pass(legs: DataFrame, dimensions: dict[str, str | None] = DIMENSIONS, *, top_n: int = DEFAULTS.top_n) -> DataFrame:
    """The breakdowns of all dimensions at the grain of legs: dimension, key (the top_n, and the rest as one), label,
    currency, legs (of the key), betslips (that name it), turnover (by currency).

    As breakdown(): one pass finds the heads of all dimensions, a second one knows every row's buckets where it is read.
    """
    names, spark = list(dimensions), legs.sparkSession
    keys = [_text(F.col(d)).alias(f"k{i}") for i, d in enumerate(names)]
    of = lambda c: F.coalesce(*[F.when(F.col(f"{c}{i}").isNotNull(), F.lit(i)) for i in range(len(names))]).alias("d")  # noqa: E731  the one column of a row that its set groups by
    one = lambda c: F.coalesce(*[F.col(f"{c}{i}") for i in range(len(names))])
    counts = legs.select(*keys).groupingSets([[f"k{i}"] for i in range(len(names))], *[f"k{i}" for i in range(len(names))]).agg(F.count("*").alias("n"))
    order = Window.partitionBy("d").orderBy(F.desc("n"), "key")  # Spark keeps top_n rows a task before it ranks
    top = counts.select(of("k"), one("k").alias("key"), "n").filter("d IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    heads: list[list[str]] = [[] for _ in names]
    for r in top.orderBy("d", "rank").collect():  # top_n rows a dimension
        heads[r["d"]].append(r["key"])
    labels = {i: F.when(F.col(f"p{i}") < len(heads[i]), F.col(dimensions[d]).cast("string")) for i, d in enumerate(names) if dimensions[d]}
    placed = legs.select("*", *[_place(k, heads[i]).alias(f"p{i}") for i, k in enumerate(_text(F.col(d)) for d in names)]).select(
        "betslip_id", F.when(money.known(F.col("currency")), F.col("currency")).alias("currency"), "turnover", *[f"p{i}" for i in range(len(names))], *[c.alias(f"l{i}") for i, c in labels.items()]
    )
    columns = [f"p{i}" for i in range(len(names))] + [f"l{i}" for i in labels] + ["currency"]
    sets = [[f"p{i}", "currency", *([f"l{i}"] if i in labels else [])] for i in range(len(names))]
    grouped = placed.groupingSets(sets, *columns).agg(F.count("*").alias("legs"), F.sum("turnover").alias("turnover"))
    label = F.coalesce(*[F.col(f"l{i}") for i in labels]) if labels else F.lit(None).cast("string")
    summed = grouped.select(of("p"), one("p").alias("place"), label.alias("label"), "currency", "legs", "turnover").filter("d IS NOT NULL").groupBy("d", "place", "currency").agg(
        F.sum("legs").alias("legs"), F.sum("turnover").alias("turnover"), F.min("label").alias("label")
    )
    counted = betslips_in(placed.select("betslip_id", *[f"p{i}" for i in range(len(names))]), len(names), max(map(len, heads)))
    shown = spark.createDataFrame([(i, p, d, k) for i, d in enumerate(names) for p, k in enumerate([*heads[i], OTHER])], "d int, place int, dimension string, key string")
    joined = summed.join(F.broadcast(counted), ["d", "place"]).join(F.broadcast(shown), ["d", "place"])  # top_n + 1 rows a dimension
    return joined.select("dimension", "key", F.coalesce("label", "key").alias("label"), "currency", "legs", "betslips", "turnover")
