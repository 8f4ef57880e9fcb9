"""Legs and betslips: derived columns, reduction to one row a betslip, collapse of versions.

Wherever the order of legs decides (first values, numbering), it is the total order ORDER.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, text
from ..functions.lookups import bitmap, in_slices, several, sieved
from ..sources.staged import written

ORDER = ("placed_at", "row_key", "version", "ggr")

#: Columns that a fingerprint covers.
FACTS = ("row_key", "version", "event_kind", "uid", "bet_type", "match_id", "market", "player", "selection", "management_unit", "fixture", "competition", "currency", "price", "turnover", "ggr", "net_revenue")

#: Columns whose identity a later version may not change.
IMMUTABLE = ("uid", "placed_at", "event_at", "bet_type", "match_id", "market", "player", "selection", "currency", "price", "turnover")


def second_of(uid: str = "uid", placed_at: str = "placed_at") -> Column:
    """The Uid and second of a leg, within which betslips are told apart: base_id."""
    return F.concat_ws("|", uid, F.coalesce(F.date_format(placed_at, "yyyyMMddHHmmss"), F.lit("NaT")))


def facts(legs: DataFrame) -> DataFrame:
    """Add what a leg tells by itself, of the columns that are there: region, is_brand_unit, uid_format,
    market_normalised, minutes_to_kickoff and is_inplay."""
    derived = {
        "region": (["management_unit"], text.management_unit), "is_brand_unit": (["management_unit"], text.is_brand_unit),
        "uid_format": (["uid"], text.uid_format), "market_normalised": (["market"], text.market),
        "minutes_to_kickoff": (["placed_at", "event_at"], clock.minutes_between),
        "is_inplay": (["placed_at", "event_at"], lambda placed, event: F.coalesce(placed > event, F.lit(False))),
    }
    wanted = {name: (of, make) for name, (of, make) in derived.items() if name not in legs.columns and set(of) <= set(legs.columns)}
    return legs.select("*", *[make(*map(F.col, of)).alias(name) for name, (of, make) in wanted.items()])


def enrich(legs: DataFrame, *, among: DataFrame | None = None) -> DataFrame:
    """Add region, is_brand_unit, uid_format, minutes_to_kickoff, is_inplay, market_normalised, base_id,
    betslip_id, had_key_collision and leg_count; of what is derived by row, what the columns allow and lack.

    One shuffle, by base_id: its windows all refine that key.  Names are normalised behind it, in a stage
    of their own: fused with the scan and its joins they would make one method too long to be compiled.

    legs may be some of a book's; among (uid, placed_at, bet_type) then has all legs of their seconds, and is what is counted.
    Betslips keep apart as in the book, though single bets are numbered among legs only.
    """
    simple = F.col("bet_type") == "SIMPLE"
    second = Window.partitionBy("base_id")
    kind = Window.partitionBy("base_id", "bet_type")
    rows = legs if "base_id" in legs.columns else legs.withColumn("base_id", second_of())
    rows = rows.select(
        "*",
        F.count("*").over(second).alias("in_second"),
        F.count("*").over(kind).alias("of_kind"),
        (F.row_number().over(kind.orderBy(*ORDER)) - 1).alias("place"),
    )
    if among is not None:
        counts = among.select(second_of().alias("of_base"), F.col("bet_type").alias("of_type")).groupBy("of_base", "of_type").agg(F.count("*").alias("kind_n"))
        counts = counts.withColumn("second_n", F.sum("kind_n").over(Window.partitionBy("of_base")))  # a row a kind
        rows = rows.join(counts, (F.col("base_id") == F.col("of_base")) & F.col("bet_type").eqNullSafe(F.col("of_type")))
        rows = rows.withColumns({"in_second": F.col("second_n"), "of_kind": F.col("kind_n")})
    own = [c for c in legs.columns if c != "base_id"]
    derived = facts(rows)
    return derived.select(
        *own,
        *[c for c in ("region", "is_brand_unit", "uid_format", "market_normalised", "minutes_to_kickoff", "is_inplay") if c in derived.columns and c not in own],
        "base_id",
        (simple & (F.col("in_second") > 1)).alias("had_key_collision"),
        F.when(simple, F.lit(1)).otherwise(F.col("of_kind")).cast("long").alias("leg_count"),
        F.when(simple, F.concat("base_id", F.lit("#"), F.col("place").cast("string"))).otherwise(F.col("base_id")).alias("betslip_id"),
    )


def betslips(legs: DataFrame) -> DataFrame:
    """One row a betslip: its first leg's facts, its legs counted, its stake once.

    Currency and amounts are those of the first leg that has one: a null on an earlier leg hides nothing.
    """
    first = F.min_by(F.struct("uid", "placed_at", "bet_type", "region", "uid_format"), F.struct(*ORDER))
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*ORDER))).alias(c) for c in ("currency", "turnover", "ggr", "net_revenue")]
    grouped = legs.groupBy("betslip_id").agg(
        first.alias("first"), *known, F.count("*").alias("legs"), F.bool_or("had_key_collision").alias("had_key_collision")
    )
    return grouped.select(
        "betslip_id", "first.uid", "first.placed_at", "first.bet_type", "first.region", "currency", "turnover", "ggr", "net_revenue", "first.uid_format", "legs", "had_key_collision"
    )


def stakes(legs: DataFrame) -> DataFrame:
    """(uid, placed_at, currency, turnover) of each betslip as betslips has them, of legs that have no betslip_id: single
    bets as they are, the other legs of a second as one."""
    single = F.coalesce(F.col("bet_type") == "SIMPLE", F.lit(False))
    order = F.struct(*ORDER)
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("currency", "turnover")]
    others = legs.filter(~single).groupBy("uid", second_of().alias("second")).agg(F.min("placed_at").alias("placed_at"), *known)
    return legs.filter(single).select("uid", "placed_at", "currency", "turnover").unionByName(others.drop("second"))


def drop_repeats(legs: DataFrame, tag: str = "source_file") -> DataFrame:
    """Rows equal in every column but the tag become one, with the smallest tag; nulls are equal."""
    values = [c for c in legs.columns if c != tag]
    return legs.groupBy(*values).agg(F.min(tag).alias(tag)) if tag in legs.columns else legs.dropDuplicates()


def dedup_funnel(legs: DataFrame, tag: str = "source_file") -> DataFrame:
    """Per file: rows_raw, rows_after, removed."""
    values = [c for c in legs.columns if c != tag]
    groups = legs.groupBy(tag, *values).agg(F.count("*").alias("n"))
    return groups.groupBy(tag).agg(
        F.sum("n").alias("rows_raw"), F.count("*").alias("rows_after"), (F.sum("n") - F.count("*")).alias("removed")
    )


def large_dedup_funnel(legs: DataFrame, by: list[str], tag: str = "source_file") -> DataFrame:
    """dedup_funnel of a large book: by are columns that tell most rows apart; rows that are alone in their hash are counted
    where they are read, and only the others are compared in all columns."""
    within = bitmap(several(legs, [tag, *by]))
    n = F.count("*")
    alone = sieved(legs, [tag, *by], within, inside=False).groupBy(tag).agg(n.alias("rows_raw"), n.alias("rows_after"), F.lit(0).cast("long").alias("removed"))
    both = dedup_funnel(sieved(legs, [tag, *by], within), tag).unionByName(alone)
    return both.groupBy(tag).agg(*[F.sum(c).alias(c) for c in ("rows_raw", "rows_after", "removed")])


def cross_source_overlap(legs: DataFrame, tag: str = "source_file") -> DataFrame:
    """How many different rows are in more than one file."""
    values = [c for c in legs.columns if c != tag]
    shared = legs.groupBy(*values).agg((F.min(tag) < F.max(tag)).alias("shared"))
    return shared.agg(F.count_if("shared").alias("overlap"))


#: Kinds of event, from the first to the last.
KINDS = ("placement", "settlement", "reversal")


def order_of(columns: list[str]) -> list[str]:
    """The columns that order versions, first to last; of_kind is the place of event_kind in KINDS, from 1, or 0."""
    leading = ("version", "ggr", "net_revenue", "turnover")
    return ["version", "of_kind", *(c for c in leading[1:] if c in columns), *sorted(c for c in columns if c not in leading)]


def newest(columns: list[str]) -> Column:
    """A version with all of its facts, as a struct whose order is total: by version, kind of event, revenue, and then by
    every other fact, so that only equal rows tie."""
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_kind")), F.lit(0)).cast("int")
    return F.struct(*[kind.alias(c) if c == "of_kind" else F.col(c) for c in order_of(columns)])


def collapse(log: DataFrame) -> DataFrame:
    """The current state of a versioned log: of each row_key the highest version.

    A partial aggregation before the shuffle; identities with many versions are combined there.
    """
    rest = [c for c in log.columns if c != "row_key"]
    return log.groupBy("row_key").agg(F.max(newest(rest)).alias("now")).select("row_key", *[F.col(f"now.{c}") for c in rest])


def _versions(log: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of identities with one version, and the others (written), of a large log.  by: columns that rows of one identity
    share.  Some of the former may be among the latter."""
    within = bitmap(several(log, by))
    return sieved(log, by, within, inside=False), written(sieved(log, by, within))


def large_collapse(log: DataFrame, by: list[str]) -> DataFrame:
    """collapse of a large log: identities with one version are their own state; only the others are dealt with their facts."""
    once, others = _versions(log, by)
    return once.unionByName(in_slices(others, "row_key", lambda of_slice: collapse(of_slice(others)), wide=4))


def large_immutable_conflicts(log: DataFrame, by: list[str]) -> DataFrame:
    """immutable_conflicts of a large log: an identity with one version has none."""
    _, others = _versions(log, by)
    return in_slices(others, "row_key", lambda of_slice: immutable_conflicts(of_slice(others)), wide=4)


def immutable_conflicts(log: DataFrame) -> DataFrame:
    """Identities of which a version changes what may not change, with the columns it changes."""
    checks = [
        F.when((F.count(F.col(c)) > 0) & (F.min(F.col(c)) != F.max(F.col(c))) | (F.count(F.col(c)).between(1, F.count("*") - 1)), F.lit(c))
        for c in IMMUTABLE
    ]
    found = log.groupBy("row_key").agg(F.count("*").alias("versions"), F.array_compact(F.array(*checks)).alias("changed"))
    return found.filter(F.size("changed") > 0)


def stream_position(log: DataFrame) -> DataFrame:
    """Of the log itself, not collapsed: highest version, rows, identities and what is still to be superseded."""
    return log.agg(
        F.max("version").alias("position"),
        F.count("*").alias("rows_stored"),
        F.countDistinct("row_key").alias("identities"),
    ).withColumn("pending_supersedence", F.col("rows_stored") - F.col("identities"))


def fingerprint(log: DataFrame) -> DataFrame:
    """Rows of the collapsed log and the exact sum of their hashes, as text, whatever their order.

    A hash (60 bits) covers the identity, the version and every fact that a version may bring, each with its length, so
    that no two rows of different facts have one text and a null is no empty text.  A sum shows accidents and reordering;
    it is no proof against someone who looks for rows that cancel out.
    """
    fact = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    facts = [F.coalesce(fact(F.col(c)), F.lit("-")) for c in FACTS]
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *facts).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return collapse(log).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("digest"))


def universe(legs: DataFrame) -> DataFrame:
    """One row of counters, from one scan and one shuffle of what differs: values by kind combine before it, and
    the counters that need no values ride on the betslips."""
    kinds = {"betslips": "betslip_id", "uids": "uid", "fixtures": "match_id", "competitions": "competition", "markets": "market_normalised"}
    entries = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(c).cast("string").alias("value")) for name, c in kinds.items()])
    rows = legs.select(F.explode(entries).alias("e"), F.to_date("placed_at").alias("day"), F.col("is_inplay").cast("int").alias("inplay"))
    found = rows.groupBy("e.kind", "e.value").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum("inplay").alias("inplay"))
    slips = F.col("kind") == "betslips"  # of each leg one
    return found.agg(
        F.coalesce(F.sum(F.when(slips, F.col("n"))), F.lit(0)).alias("legs"), F.min(F.when(slips, F.col("first"))).cast("string").alias("first_day"),
        F.max(F.when(slips, F.col("last"))).cast("string").alias("last_day"), F.coalesce(F.sum(F.when(slips, F.col("inplay"))), F.lit(0)).alias("inplay_legs"),
        *[F.count_if((F.col("kind") == name) & F.col("value").isNotNull()).alias(name) for name in kinds],
    )
