import json

import pytest
from conftest import rows

from wagerlens.operators import reconcile as R
from wagerlens.sources.feeds import load_alpha, load_beta


def player(i, team, name, goals=0, shots=0, on=0, position="FW"):
    return {"player_id": i, "team_id": team, "name": name, "position": position, "stats": {"goals": goals, "shots": shots, "shots_on_target": on}}


def person(i, team, label, g=0, sh=0, sot=0):
    return {"id": i, "team": team, "label": label, "perf": {"g": g, "sh": sh, "sot": sot}}


ALPHA = {
    "provider": "alpha", "feed_version": "7",
    "fixture": {"fixture_id": 88, "competition": "Copa Austral", "kickoff_utc": "2024-11-09T15:30:00Z", "status": "complete",
                "home_team": {"team_id": 31, "name": "Puerto Azul"}, "away_team": {"team_id": 32, "name": "Union Sur FC"}, "final_score": {"home": 3, "away": 1}},
    "players": [player(11, 31, "Tomás Ibáñez", 2, 5, 3), player(12, 31, "Rafa"), player(13, 31, "Éric Zu", position="GK"), player(21, 32, "João Prado", 1, 1, 1), player(22, 32, "Milo Kerr")],
    "markets": [{"code": "OU_TOTAL_GOALS@3.5", "selection": "UNDER", "price": 2.2}, {"code": "PLAYER_SHOTS_ON@11@1.5", "selection": " Over", "price": 3.1}, {"code": "OU_TOTAL_GOALS@4.5", "selection": "OVER", "price": 5.0}, {"code": "CORNERS@9", "selection": "EVEN", "price": 1.9}],
}
BETA = {
    "provider": "beta", "feed_version": "2",
    "event": {"event_ref": "z-88", "league": "Copa Austral 2024", "start": "2024-11-09T16:30:00+02:00", "settled": False,
              "teams": {"home": {"id": "PAZ", "short": "Puert Azul"}, "away": {"id": "ATS", "short": "Atletico Sur"}}, "result": {"home_goals": 2, "away_goals": 1}},
    "lineup": [person("q1", "PAZ", "T. Ibanez", 2, 5, 2), person("q2", "PAZ", "Rafael Mota"), person("q3", "ATS", "J. Prado", 1, 1, 1), person("q4", None, "Unknown Player"), person("q5", "ATS", "Nils Berg")],
    "prices": [{"market": "total_goals", "line": 3.5, "runner": " Under ", "odds": "6/5"}, {"market": "player_shots_on_target", "player": "q1", "line": 1.5, "runner": "over", "odds": "2/1"}, {"market": "btts", "runner": "no", "odds": "3/4"}],
}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    for i in (1, 2):
        (folder / f"m{i}_alpha.json").write_text(json.dumps(ALPHA, indent=1))
        (folder / f"m{i}_beta.json").write_text(json.dumps(BETA, indent=1))
    return R.reconcile(load_alpha(spark, f"{folder}/*_alpha.json"), load_beta(spark, f"{folder}/*_beta.json"))


def one(df):
    first = min(r["match_ref"] for r in df.select("match_ref").collect())
    return [r for r in rows(df) if r["match_ref"] == first]


def test_both_matches_are_reconciled_alike(result):
    for df in (result.teams, result.players, result.markets, result.reviews):
        per = df.groupBy("match_ref").count().collect()
        assert len(per) == 2 and per[0]["count"] == per[1]["count"]


def test_teams(result):
    got = {r["role"]: (r["alpha_id"], r["beta_id"], r["confidence"], r["status"]) for r in one(result.teams)}
    assert got == {"home": ("31", "PAZ", 0.9, "matched"), "away": ("32", "ATS", None, "provisional")}


def test_players(result):
    got = {(r["alpha_id"], r["beta_id"]): (r["status"], r["confidence"], r["method"]) for r in one(result.players)}
    assert got == {
        ("11", "q1"): ("matched", 0.9, "initial_expansion"), ("21", "q3"): ("matched", 0.9, "initial_expansion"), ("12", "q2"): ("provisional", 0.6, "nickname_prefix"),
        ("13", None): ("unmatched", None, "no_candidate"), ("22", None): ("unmatched", None, "no_candidate"), (None, "q5"): ("unmatched", None, "no_candidate"), (None, "q4"): ("unmatched", None, "placeholder"),
    }


def test_greedy_assignment_is_one_to_one(spark):
    pairs = [("m", "home", "1", "x", 0.6, 0, 0), ("m", "home", "2", "x", 1.0, 1, 0), ("m", "home", "1", "y", 0.6, 0, 1), ("m", "home", "3", "y", 0.6, 2, 1)]
    got = R.assign(spark.createDataFrame(pairs, "match_ref string, role string, alpha_id string, beta_id string, confidence double, a_place int, b_place int"))
    assert {(r["alpha_id"], r["beta_id"]) for r in rows(got)} == {("2", "x"), ("1", "y")}


def test_markets(result):
    got = {(r["market_type"], r["line"], r["selection"]): r for r in one(result.markets)}
    assert got[("total_goals", 3.5, "under")]["agreement"] is True and got[("total_goals", 3.5, "under")]["status"] == "matched"
    shots = got[("player_shots_on_target", 1.5, "over")]
    assert shots["player_ref"] == "a:11" and shots["agreement"] is False and (shots["alpha_price"], shots["beta_price"]) == (3.1, 3.0)
    assert got[("total_goals", 4.5, "over")]["method"] == "alpha_only" and got[("btts", None, "no")]["method"] == "beta_only" and got[("unknown", None, "even")]["alpha_code"] == "CORNERS@9"


def test_match_fields(result):
    (m,) = one(result.match)
    assert m["kickoff"] == "2024-11-09T15:30:00+00:00" and not m["kickoff_agreement"] and m["competition_agreement"] and m["competition"] == "Copa Austral 2024" and not m["status_agreement"]
    (s,) = one(result.score)
    assert s["value"] == {"home": 2, "away": 1} and not s["agreement"] and s["basis"] == "goal_tally" and s["chosen"] == "beta"


def test_stats_and_reviews(result):
    odd = [(r["alpha_id"], r["stat"], r["value"], r["alpha_value"], r["beta_value"]) for r in one(result.stats) if not r["agreement"]]
    assert odd == [("11", "shots_on_target", 3, 3, 2)]
    found = sorted(one(result.reviews), key=lambda r: r["review_id"])
    assert [r["review_id"] for r in found] == [f"R{i:02d}" for i in range(1, len(found) + 1)] and [r["step"] for r in found] == sorted(r["step"] for r in found)
    assert [(r["category"], r["entity_type"], r["severity"]) for r in found] == [
        ("value_conflict", "team", "high"), ("provisional_mapping", "player", "medium"), ("entity_unmatched", "player", "low"), ("entity_unmatched", "player", "low"), ("entity_unmatched", "player", "low"),
        ("data_quality", "player", "medium"), ("market_unmatched", "market", "low"), ("market_unmatched", "market", "low"), ("market_unmatched", "market", "low"), ("value_conflict", "match", "high"),
        ("value_conflict", "match", "high"), ("value_conflict", "player_stat", "medium"), ("price_divergence", "selection", "info"),
    ]
    assert all(r["suggested_action"] and r["reason"] for r in found)
    score = next(r for r in found if r["entity_ref"] == "final score")
    assert json.loads(score["competing_values"])["beta_goal_tally"] == {"home": 2, "away": 1} and score["resolution"] == "beta by goal_tally"
    assert json.loads(found[-1]["competing_values"]) == {"alpha": 3.1, "beta": 3.0} and (found[1]["alpha_id"], found[1]["beta_id"]) == ("12", "q2")


def test_records_refer_to_their_reviews(result):
    (m,) = [r for r in rows(R.canonical(result)) if r["match_ref"] == min(x["match_ref"] for x in result.match.collect())]
    by_id = {r["review_id"]: r for r in m["reviews"]}
    assert by_id[m["score"]["review_ref"]]["entity_ref"] == "final score" and by_id[m["kickoff_review_ref"]]["entity_ref"] == "kickoff"
    assert {by_id[p["review_ref"]]["entity_ref"] for p in m["players"] if p["review_ref"]} == {"Rafa", "Éric Zu", "Milo Kerr", "Nils Berg", "Unknown Player"}
    assert [by_id[q["review_ref"]]["category"] for q in m["markets"] if q["review_ref"]].count("market_unmatched") == 3 and sum(bool(x["review_ref"]) for x in m["stats"]) == 1


def test_canonical_is_whole_and_repeatable(result):
    one_run, two_run = rows(R.canonical(result)), rows(R.canonical(result))
    assert one_run == two_run and len(one_run) == 2 and len(one_run[0]["players"]) == 7
    assert {(r["kind"], r["value"]) for r in rows(R.summary(result))} >= {("player", "matched"), ("review", "high")}


def test_the_command_writes_every_match(spark, tmp_path, monkeypatch):
    from wagerlens.__main__ import main

    (tmp_path / "m_alpha.json").write_text(json.dumps(ALPHA, indent=1))
    (tmp_path / "m_beta.json").write_text(json.dumps(BETA, indent=1))
    many = spark.range(1500).selectExpr("id AS match_ref", "CASE WHEN id > 0 THEN id END AS other")
    monkeypatch.setattr(R, "canonical", lambda result: many)
    assert main(["reconcile", "--alpha", f"{tmp_path}/*_alpha.json", "--beta", f"{tmp_path}/*_beta.json", "--out", f"{tmp_path}/out"]) == 0
    found = json.loads((tmp_path / "out" / "canonical.json").read_text())
    assert sorted(r["match_ref"] for r in found) == list(range(1500)) and {"match_ref": 0, "other": None} in found
    assert json.loads((tmp_path / "out" / "reviews.json").read_text())
