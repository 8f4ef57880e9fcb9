"""Two providers' feeds of matches from a star schema: suppliers are matches, nations players of both teams.

The second feed abbreviates, misspells, omits and adds, so that every step of the reconciliation has work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odds import canonical_market, market_code, require_fraction
from .feeds import Feed


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match m and nation n of its squads."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("m"), "s_name")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n"), F.lower("n_name").alias("n_name"), F.col("n_regionkey").cast("long").alias("r"))
    # a match has the nations of one residue modulo 3: a join on that number, not a product
    squads = nations.withColumn("own", F.col("n") % 3)
    return suppliers.withColumn("own", F.pmod(-F.col("m"), F.lit(3))).join(squads, "own").select("m", "s_name", "n", "n_name", "r")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("m"), "s_name", F.col("s_nationkey").cast("long").alias("country"))


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def feeds(spark: SparkSession, sf_dir: str) -> tuple[Feed, Feed]:
    m, n, r = F.col("m"), F.col("n"), F.col("r")
    ref = _text("m", m).alias("match_ref")
    every, squads = _matches(spark, sf_dir), _wide(spark, sf_dir)
    given = F.initcap(F.element_at(F.split("n_name", " "), 1))
    surname = F.when(r % 2 == 0, "Silva").otherwise("Costa")
    goals, shots = ((n + m) % 4 % 3).cast("int"), ((n * 3 + m) % 7).cast("int")
    team = F.when(n % 2 == 0, "H").otherwise("A")

    squad_a = squads.filter(n % 8 != 6).select(
        ref, n.cast("int").alias("place"), _text(m, "0", n).alias("player_id"), _text("a", team, m).alias("team_id"), F.concat_ws(" ", given, surname).alias("name"),
        F.lit("FW").alias("position"), goals.alias("goals"), shots.alias("shots"), F.when(n % 6 != 5, shots - goals).cast("int").alias("shots_on_target"), "m", "n",
    )
    label = F.when(n % 8 == 3, "Unknown Player").when(n % 4 == 0, F.upper(F.concat_ws("  ", given, surname))).when(n % 4 == 1, F.concat(F.substring(given, 1, 1), F.lit(". "), surname))
    label = label.when(n % 4 == 2, F.substring(given, 1, 4)).otherwise(F.concat_ws(" ", given, surname))
    squad_b = squads.filter(n % 7 != 5).select(
        ref, (100 - n).cast("int").alias("place"), _text("p", n, "-", m).alias("player_id"), F.when(n % 8 != 3, _text("b", team, m)).alias("team_id"), label.alias("name"),
        F.lit(None).cast("string").alias("position"), goals.alias("goals"), (shots + F.when((n + m) % 5 == 0, 1).otherwise(0)).cast("int").alias("shots"),
        F.when(n % 6 != 4, shots - goals).cast("int").alias("shots_on_target"), "m", "n",
    )

    def tally(squad: DataFrame, side: str) -> DataFrame:
        named = squad.filter(F.col("team_id").isNotNull()).groupBy("m").agg(*[F.sum(F.when(F.col("team_id").startswith(f"{side}{t}"), F.col("goals")).otherwise(0)).alias(t) for t in "HA"])
        return every.join(named, "m", "left").fillna(0, ["H", "A"])

    kickoff = lambda hour, zone: F.concat(F.lit("2025-03-"), F.lpad((m % 27 + 1).cast("string"), 2, "0"), F.lit("T"), hour, F.lit(f":00:00{zone}"))
    league = _text("League ", F.col("country"))
    matches_a = tally(squad_a, "a").select(
        ref, F.when(m % 4 == 0, F.concat(F.lit("National "), league)).otherwise(league).alias("competition"), kickoff(F.lit("18"), "Z").alias("kickoff"), F.when(m % 13 == 0, "in_play").otherwise("complete").alias("status"),
        (m % 13 != 0).alias("settled"), (F.col("H") + F.when(m % 5 == 0, 1).otherwise(0)).cast("int").alias("home_goals"), F.col("A").cast("int").alias("away_goals"),
    )
    matches_b = tally(squad_b, "b").select(
        ref, F.when(m % 7 == 0, F.lit("Cup")).otherwise(league).alias("competition"), kickoff(F.when(m % 11 == 0, "20").otherwise("19"), "+01:00").alias("kickoff"), F.lit("true").alias("status"),
        F.lit(True).alias("settled"), (F.col("H") + F.when(m % 3 == 0, 1).otherwise(0)).cast("int").alias("home_goals"), F.col("A").cast("int").alias("away_goals"),
    )

    def teams(side: str, home, away) -> DataFrame:
        parts = F.array(F.struct(F.lit("home").alias("role"), _text(side, "H", m).alias("team_id"), home.alias("name")), F.struct(F.lit("away").alias("role"), _text(side, "A", m).alias("team_id"), away.alias("name")))
        return every.select(ref, F.explode(parts).alias("t")).select("match_ref", "t.*")

    club = _text("Club ", m)
    teams_a = teams("a", F.col("s_name"), club)
    teams_b = teams("b", F.when(m % 9 == 0, "Rovers").when(m % 5 == 0, F.substring("s_name", 1, 4)).otherwise(F.concat(F.upper("s_name"), F.lit(" FC"))), F.when(m % 2 == 0, _text("Clu ", m)).otherwise(club))

    def quotes(rows: DataFrame) -> DataFrame:
        return rows.select("match_ref", F.col("place").cast("int").alias("place"), "market_type", "line", "player_id", "code", "selection", F.col("price").cast("double").alias("price"))

    code = F.concat(F.lit("PLAYER_GOALS@"), F.col("player_id"), F.lit("@0.5"))
    goals_a = squad_a.select("match_ref", (F.col("place") + 10).alias("place"), code.alias("code"), F.lit(" Over ").alias("selection"), (F.lit(1.5) + n / 10).alias("price"))
    fixed_a = every.select(ref, F.explode(F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(c).alias("code"), F.lit(s).alias("selection"), p.alias("price")) for i, (c, s, p) in enumerate((
            ("OU_TOTAL_GOALS@2.5", "OVER", F.lit(1.8)), ("OU_TOTAL_GOALS@2.5", "UNDER", F.lit(2.0)), ("OU_TOTAL_GOALS@2.5", "OVER", 1.75 + m % 3 / 20), ("MYSTERY@1", "A", F.lit(3.0)),
        ))],
    )).alias("q")).select("match_ref", "q.*").unionByName(every.filter(m % 2 == 0).select(ref, F.lit(4).alias("place"), F.lit("BTTS").alias("code"), F.lit("YES").alias("selection"), F.lit(1.7).alias("price")))
    all_a = fixed_a.unionByName(goals_a).withColumn("c", market_code(F.col("code"))).select("match_ref", "place", "c.market_type", "c.line", F.col("c.player_source_id").alias("player_id"), "code", F.lower(F.trim("selection")).alias("selection"), "price")

    goals_b = squad_b.select("match_ref", (F.col("place") + 10).alias("place"), F.lit("player_to_score").alias("code"), F.lit(0.5).alias("line"), "player_id", F.lit("over").alias("selection"), _text(5 + n + F.when(n % 5 == 0, 1).otherwise(0), "/10").alias("odds"))
    fixed_b = every.select(ref, F.explode(F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(c).alias("code"), F.lit(x).cast("double").alias("line"), F.lit(s).alias("selection"), F.lit(o).alias("odds")) for i, (c, x, s, o) in enumerate((
            ("total_goals", 2.5, "over", "4/5"), ("total_goals", 2.5, "Under", "1/1"), ("asian_handicap", -1.5, "home", "21/20"),
        ))],
    )).alias("q")).select("match_ref", "q.*").withColumn("player_id", F.lit(None).cast("string"))
    all_b = fixed_b.unionByName(goals_b).select("match_ref", "place", canonical_market(F.col("code")).alias("market_type"), "line", "player_id", "code", F.lower(F.trim("selection")).alias("selection"), require_fraction(F.col("odds")).alias("price"))
    return Feed(matches_a, teams_a, squad_a.drop("m", "n"), quotes(all_a)), Feed(matches_b, teams_b, squad_b.drop("m", "n"), quotes(all_b))
