"""Two providers' feeds of matches, as four flat frames of one schema each.

A file holds one match.  All frames carry match_ref, the name of the pair that a match's two files
share, so that any number of matches is reconciled in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odds import canonical_market, market_code, require_fraction

ALPHA = """provider string, feed_version string, note string,
fixture struct<fixture_id:long, competition:string, kickoff_utc:string, status:string,
  home_team:struct<team_id:long, name:string>, away_team:struct<team_id:long, name:string>, final_score:struct<home:int, away:int>>,
players array<struct<player_id:long, team_id:long, name:string, position:string, stats:struct<goals:int, shots:int, shots_on_target:int>>>,
markets array<struct<code:string, selection:string, price:double>>"""

BETA = """provider string, feed_version string, note string,
event struct<event_ref:string, league:string, start:string, settled:boolean,
  teams:struct<home:struct<id:string, short:string>, away:struct<id:string, short:string>>, result:struct<home_goals:int, away_goals:int>>,
lineup array<struct<id:string, team:string, label:string, perf:struct<g:int, sh:int, sot:int>>>,
prices array<struct<market:string, player:string, line:double, runner:string, odds:string>>"""


@dataclass(frozen=True)
class Feed:
    """matches: match_ref, competition, kickoff, status, settled, home_goals, away_goals.
    teams: match_ref, role, team_id, name.  players: match_ref, place, player_id, team_id, name, position,
    goals, shots, shots_on_target.  quotes: match_ref, place, market_type, line, player_id, code, selection, price."""

    matches: DataFrame
    teams: DataFrame
    players: DataFrame
    quotes: DataFrame


def _read(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("match_ref", F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1), r"(?i)provider_|alpha|beta", ""))


def _selection(name: Column) -> Column:
    return F.lower(F.trim(name))


def load_alpha(spark: SparkSession, path: str | list[str]) -> Feed:
    """Numeric ids become text; a market's code holds its type, player and line."""
    raw = _read(spark, path, ALPHA)
    f = "fixture."
    matches = raw.select(
        "match_ref", F.col(f + "competition").alias("competition"), F.col(f + "kickoff_utc").alias("kickoff"), F.col(f + "status").alias("status"),
        (F.lower(f + "status") == "complete").alias("settled"), F.col(f + "final_score.home").alias("home_goals"), F.col(f + "final_score.away").alias("away_goals"),
    )
    teams = raw.select("match_ref", F.explode(F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(f"fixture.{r}_team.team_id").cast("string").alias("team_id"), F.col(f"fixture.{r}_team.name").alias("name")) for r in ("home", "away")]
    )).alias("t")).select("match_ref", "t.*")
    players = raw.select("match_ref", F.posexplode("players").alias("place", "p")).select(
        "match_ref", "place", F.col("p.player_id").cast("string").alias("player_id"), F.col("p.team_id").cast("string").alias("team_id"), "p.name", "p.position", "p.stats.*"
    )
    quotes = raw.select("match_ref", F.posexplode("markets").alias("place", "m")).withColumn("code", market_code(F.col("m.code"))).select(
        "match_ref", "place", "code.market_type", "code.line", F.col("code.player_source_id").alias("player_id"), F.col("m.code").alias("code"), _selection(F.col("m.selection")).alias("selection"), "m.price"
    )
    return Feed(matches, teams, players, quotes)


def load_beta(spark: SparkSession, path: str | list[str]) -> Feed:
    """Text ids, a team may be missing, odds are fractions; malformed odds end the job."""
    raw = _read(spark, path, BETA)
    matches = raw.select(
        "match_ref", F.col("event.league").alias("competition"), F.col("event.start").alias("kickoff"), F.col("event.settled").cast("string").alias("status"),
        F.col("event.settled").alias("settled"), F.col("event.result.home_goals").alias("home_goals"), F.col("event.result.away_goals").alias("away_goals"),
    )
    teams = raw.select("match_ref", F.explode(F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(f"event.teams.{r}.id").alias("team_id"), F.col(f"event.teams.{r}.short").alias("name")) for r in ("home", "away")]
    )).alias("t")).select("match_ref", "t.*")
    players = raw.select("match_ref", F.posexplode("lineup").alias("place", "p")).select(
        "match_ref", "place", F.col("p.id").alias("player_id"), F.col("p.team").alias("team_id"), F.col("p.label").alias("name"), F.lit(None).cast("string").alias("position"),
        F.col("p.perf.g").alias("goals"), F.col("p.perf.sh").alias("shots"), F.col("p.perf.sot").alias("shots_on_target"),
    )
    quotes = raw.select("match_ref", F.posexplode("prices").alias("place", "q")).select(
        "match_ref", "place", canonical_market(F.col("q.market")).alias("market_type"), "q.line", F.col("q.player").alias("player_id"), F.col("q.market").alias("code"),
        _selection(F.col("q.runner")).alias("selection"), require_fraction(F.col("q.odds")).alias("price"),
    )
    return Feed(matches, teams, players, quotes)
