"""The reconciliation's queries in DuckDB's SQL: the stand-in feeds, and each step over them."""

from __future__ import annotations

import re

from .functions.wording import ACTIONS, CHOICES, REASONS, sentence_sql

TEMPLATE = r"""
wide AS (SELECT s_suppkey::BIGINT AS m, 'm' || s_suppkey AS match_ref, s_name, n_nationkey::BIGINT AS n, string_split(lower(n_name), ' ')[1] AS g0, CASE WHEN n_regionkey % 2 = 0 THEN 'Silva' ELSE 'Costa' END AS surname,
  (n_nationkey + s_suppkey) % 4 % 3 AS goals, (n_nationkey * 3 + s_suppkey) % 7 AS shots, CASE WHEN n_nationkey % 2 = 0 THEN 'H' ELSE 'A' END AS side
  FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 3 = 0),
w AS (SELECT *, upper(g0[1]) || g0[2:] AS given FROM wide),
sa AS (SELECT m, n, match_ref, n::INT AS place, m || '0' || n AS player_id, 'a' || side || m AS team_id, given || ' ' || surname AS name, goals, shots, CASE WHEN n % 6 <> 5 THEN shots - goals END AS shots_on_target FROM w WHERE n % 8 <> 6),
sb AS (SELECT m, n, match_ref, (100 - n)::INT AS place, 'p' || n || '-' || m AS player_id, CASE WHEN n % 8 <> 3 THEN 'b' || side || m END AS team_id,
  CASE WHEN n % 8 = 3 THEN 'Unknown Player' WHEN n % 4 = 0 THEN upper(given || '  ' || surname) WHEN n % 4 = 1 THEN given[1] || '. ' || surname WHEN n % 4 = 2 THEN given[1:4] ELSE given || ' ' || surname END AS name,
  goals, shots + CASE WHEN (n + m) % 5 = 0 THEN 1 ELSE 0 END AS shots, CASE WHEN n % 6 <> 4 THEN shots - goals END AS shots_on_target FROM w WHERE n % 7 <> 5),
ta AS (SELECT m, coalesce(sum(goals) FILTER (team_id[2] = 'H'), 0)::INT AS h, coalesce(sum(goals) FILTER (team_id[2] = 'A'), 0)::INT AS a FROM (SELECT s_suppkey AS m, team_id, goals FROM supplier LEFT JOIN sa ON sa.m = s_suppkey) GROUP BY 1),
tb AS (SELECT m, coalesce(sum(goals) FILTER (team_id[2] = 'H'), 0)::INT AS h, coalesce(sum(goals) FILTER (team_id[2] = 'A'), 0)::INT AS a FROM (SELECT s_suppkey AS m, team_id, goals FROM supplier LEFT JOIN sb ON sb.m = s_suppkey) GROUP BY 1),
teams0 AS (SELECT s_suppkey AS m, 'm' || s_suppkey AS match_ref, unnest([
  {'role': 'home', 'alpha_id': 'aH' || s_suppkey, 'beta_id': 'bH' || s_suppkey, 'alpha_name': s_name, 'beta_name': CASE WHEN s_suppkey % 9 = 0 THEN 'Rovers' WHEN s_suppkey % 5 = 0 THEN s_name[1:4] ELSE upper(s_name) || ' FC' END},
  {'role': 'away', 'alpha_id': 'aA' || s_suppkey, 'beta_id': 'bA' || s_suppkey, 'alpha_name': 'Club ' || s_suppkey, 'beta_name': CASE WHEN s_suppkey % 2 = 0 THEN 'Clu ' || s_suppkey ELSE 'Club ' || s_suppkey END}]) AS t FROM supplier),
teams1 AS (SELECT m, match_ref, t.*, list_filter(string_split(lower(t.alpha_name), ' '), lambda x: x NOT IN ('fc', 'afc', 'cf', 'sc')) AS x, list_filter(string_split(lower(t.beta_name), ' '), lambda x: x NOT IN ('fc', 'afc', 'cf', 'sc')) AS y FROM teams0),
teams AS (SELECT *, CASE WHEN x = y THEN 1.0 WHEN len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda p: NOT (starts_with(p[1], p[2]) OR starts_with(p[2], p[1])))) = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS tier FROM teams1),
na AS (SELECT sa.*, CASE sa.team_id[2] WHEN 'H' THEN 'home' ELSE 'away' END AS role, lower(name) AS f FROM sa),
nb AS (SELECT sb.*, CASE sb.team_id[2] WHEN 'H' THEN 'home' WHEN 'A' THEN 'away' END AS role, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS f FROM sb),
pairs0 AS (SELECT na.match_ref, na.role, na.player_id AS alpha_id, nb.player_id AS beta_id, na.place AS a_place, nb.place AS b_place, na.f AS fx, nb.f AS fy, string_split(na.f, ' ') AS x, string_split(nb.f, ' ') AS y
  FROM na JOIN nb ON na.match_ref = nb.match_ref AND na.role = nb.role WHERE nb.team_id IS NOT NULL AND nb.f NOT IN ('unidentified player', 'unknown player', 'unknown')),
pairs AS (SELECT *, CASE WHEN fx = fy THEN 1.0
  WHEN x[-1] = y[-1] AND (len(rtrim(y[1], '.')) = 1 AND len(list_filter(x[:len(x) - 1], lambda t: starts_with(t, rtrim(y[1], '.')))) > 0 OR len(rtrim(x[1], '.')) = 1 AND len(list_filter(y[:len(y) - 1], lambda t: starts_with(t, rtrim(x[1], '.')))) > 0) THEN 0.9
  WHEN len(x) = 1 AND starts_with(y[1], x[1]) OR len(y) = 1 AND starts_with(x[1], y[1]) THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM pairs0),
candidates AS (SELECT match_ref, role, alpha_id, beta_id, confidence, a_place, b_place FROM pairs WHERE confidence >= 0.5),
ordered AS (SELECT *, row_number() OVER (PARTITION BY match_ref ORDER BY confidence DESC, alpha_id, a_place, b_place) AS i FROM candidates),
walk AS (
  SELECT DISTINCT match_ref, 0::BIGINT AS i, []::VARCHAR[] AS ta, []::VARCHAR[] AS tb, false AS hit FROM ordered
  UNION ALL
  SELECT w.match_ref, o.i, CASE WHEN list_contains(w.ta, o.alpha_id) OR list_contains(w.tb, o.beta_id) THEN w.ta ELSE list_append(w.ta, o.alpha_id) END,
         CASE WHEN list_contains(w.ta, o.alpha_id) OR list_contains(w.tb, o.beta_id) THEN w.tb ELSE list_append(w.tb, o.beta_id) END, NOT (list_contains(w.ta, o.alpha_id) OR list_contains(w.tb, o.beta_id))
  FROM walk w JOIN ordered o ON o.match_ref = w.match_ref AND o.i = w.i + 1),
chosen AS (SELECT o.match_ref, o.alpha_id, o.beta_id, o.confidence FROM walk w JOIN ordered o USING (match_ref, i) WHERE hit),
players AS (
  SELECT na.match_ref, 0 AS part, na.place, na.name AS canonical_name, na.role, 'FW' AS position, na.player_id AS alpha_id, c.beta_id, na.name AS alpha_name, nb.name AS beta_name,
         CASE WHEN c.confidence >= 0.8 THEN 'matched' WHEN c.confidence IS NOT NULL THEN 'provisional' ELSE 'unmatched' END AS status, c.confidence,
         CASE c.confidence WHEN 1.0 THEN 'exact_after_normalization' WHEN 0.9 THEN 'initial_expansion' WHEN 0.6 THEN 'nickname_prefix' ELSE 'no_candidate' END AS method
  FROM na LEFT JOIN chosen c ON c.match_ref = na.match_ref AND c.alpha_id = na.player_id LEFT JOIN nb ON nb.match_ref = na.match_ref AND nb.player_id = c.beta_id
  UNION ALL
  SELECT match_ref, CASE WHEN ok THEN 1 ELSE 2 END, place, name, CASE WHEN ok THEN role END, NULL, NULL, player_id, NULL, name, 'unmatched', NULL, CASE WHEN ok THEN 'no_candidate' ELSE 'placeholder' END
  FROM (SELECT *, team_id IS NOT NULL AND f NOT IN ('unidentified player', 'unknown player', 'unknown') AS ok FROM nb) b WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.match_ref = b.match_ref AND c.beta_id = b.player_id)),
qa AS (
  SELECT 'm' || s_suppkey AS match_ref, unnest([
    {'place': 0, 'market_type': 'total_goals', 'line': 2.5::DOUBLE, 'player_ref': NULL::VARCHAR, 'code': 'OU_TOTAL_GOALS@2.5', 'selection': 'over', 'price': 1.8::DOUBLE},
    {'place': 1, 'market_type': 'total_goals', 'line': 2.5::DOUBLE, 'player_ref': NULL, 'code': 'OU_TOTAL_GOALS@2.5', 'selection': 'under', 'price': 2.0::DOUBLE},
    {'place': 2, 'market_type': 'total_goals', 'line': 2.5::DOUBLE, 'player_ref': NULL, 'code': 'OU_TOTAL_GOALS@2.5', 'selection': 'over', 'price': 1.75::DOUBLE + s_suppkey % 3 / 20},
    {'place': 3, 'market_type': 'unknown', 'line': NULL, 'player_ref': 'a:1', 'code': 'MYSTERY@1', 'selection': 'a', 'price': 3.0::DOUBLE}]) AS q FROM supplier
  UNION ALL SELECT 'm' || s_suppkey, {'place': 4, 'market_type': 'btts', 'line': NULL, 'player_ref': NULL, 'code': 'BTTS', 'selection': 'yes', 'price': 1.7::DOUBLE} FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT match_ref, {'place': place + 10, 'market_type': 'player_goals', 'line': 0.5::DOUBLE, 'player_ref': 'a:' || player_id, 'code': 'PLAYER_GOALS@' || player_id || '@0.5', 'selection': 'over', 'price': 1.5::DOUBLE + n / 10} FROM sa),
qb AS (
  SELECT 'm' || s_suppkey AS match_ref, unnest([
    {'place': 0, 'market_type': 'total_goals', 'line': 2.5::DOUBLE, 'player_ref': NULL::VARCHAR, 'code': 'total_goals', 'selection': 'over', 'price': 1.8::DOUBLE},
    {'place': 1, 'market_type': 'total_goals', 'line': 2.5::DOUBLE, 'player_ref': NULL, 'code': 'total_goals', 'selection': 'under', 'price': 2.0::DOUBLE},
    {'place': 2, 'market_type': 'asian_handicap', 'line': -1.5::DOUBLE, 'player_ref': NULL, 'code': 'asian_handicap', 'selection': 'home', 'price': 2.05::DOUBLE}]) AS q FROM supplier
  UNION ALL SELECT sb.match_ref, {'place': sb.place + 10, 'market_type': 'player_goals', 'line': 0.5::DOUBLE, 'player_ref': coalesce('a:' || c.alpha_id, 'b:' || sb.player_id), 'code': 'player_to_score', 'selection': 'over',
    'price': round((5 + n + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,4) / 10 + 1, 4)::DOUBLE} FROM sb LEFT JOIN chosen c ON c.match_ref = sb.match_ref AND c.beta_id = sb.player_id),
xa AS (SELECT match_ref, q.market_type, q.line, q.player_ref, q.selection, max_by(q, q.place) AS q FROM qa GROUP BY ALL),
xb AS (SELECT match_ref, q.market_type, q.line, q.player_ref, q.selection, max_by(q, q.place) AS q FROM qb GROUP BY ALL),
met AS (
  SELECT coalesce(xa.match_ref, xb.match_ref) AS match_ref, coalesce(xa.market_type, xb.market_type) AS market_type, CASE WHEN xa.match_ref IS NOT NULL THEN xa.line ELSE xb.line END AS line,
         CASE WHEN xa.match_ref IS NOT NULL THEN xa.player_ref ELSE xb.player_ref END AS player_ref, coalesce(xa.selection, xb.selection) AS selection, xa.q.price AS alpha_price, xb.q.price AS beta_price,
         xa.q.code AS alpha_code, xb.q.code AS beta_code, coalesce(xa.q.place, xb.q.place + 100000)::INT AS place
  FROM xa FULL JOIN xb ON xa.match_ref = xb.match_ref AND xa.market_type = xb.market_type AND xa.line IS NOT DISTINCT FROM xb.line AND xa.player_ref IS NOT DISTINCT FROM xb.player_ref AND xa.selection = xb.selection),
sided AS (SELECT *, max(alpha_code) OVER w IS NOT NULL AS ia, max(beta_code) OVER w IS NOT NULL AS ib FROM met WINDOW w AS (PARTITION BY match_ref, market_type, line, player_ref)),
markets AS (
  SELECT * EXCLUDE (ia, ib), CASE WHEN ia AND ib THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN ia AND ib THEN 1.0::DOUBLE END AS confidence,
         CASE WHEN ia AND ib THEN 'key_match' WHEN ia THEN 'alpha_only' ELSE 'beta_only' END AS method, abs(alpha_price - beta_price) < 0.001 AS agreement FROM sided),
score0 AS (
  SELECT 'm' || s_suppkey AS match_ref, ta.h + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS alpha_home, ta.a AS alpha_away, tb.h + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS beta_home, tb.a AS beta_away,
         ta.h AS alpha_tally_home, ta.a AS alpha_tally_away, tb.h AS beta_tally_home, tb.a AS beta_tally_away FROM supplier JOIN ta ON ta.m = s_suppkey JOIN tb ON tb.m = s_suppkey),
score1 AS (SELECT *, alpha_home = beta_home AND alpha_away = beta_away AS agreement, alpha_home = alpha_tally_home AND alpha_away = alpha_tally_away AS fa, beta_home = beta_tally_home AND beta_away = beta_tally_away AS fb FROM score0),
score2 AS (SELECT *, CASE WHEN NOT agreement AND fb AND NOT fa THEN 'beta' ELSE 'alpha' END AS chosen, CASE WHEN agreement THEN 'agreed' WHEN fa <> fb THEN 'goal_tally' ELSE 'prior' END AS basis FROM score1),
score AS (SELECT * EXCLUDE (fa, fb), CASE chosen WHEN 'beta' THEN beta_home ELSE alpha_home END AS value_home, CASE chosen WHEN 'beta' THEN beta_away ELSE alpha_away END AS value_away FROM score2),
matches0 AS (
  SELECT s_suppkey AS m, 'm' || s_suppkey AS match_ref, '2025-03-' || lpad((s_suppkey % 27 + 1)::VARCHAR, 2, '0') || 'T' AS d, 'League ' || s_nationkey AS league FROM supplier),
matches AS (
  SELECT match_ref, d || '18:00:00+00:00' AS kickoff, m % 11 <> 0 AS kickoff_agreement, d || '18:00:00Z' AS alpha_kickoff, d || CASE WHEN m % 11 = 0 THEN '20' ELSE '19' END || ':00:00+01:00' AS beta_kickoff,
         CASE WHEN m % 4 = 0 THEN 'National ' || league ELSE league END AS competition, m % 7 <> 0 AS competition_agreement, CASE WHEN m % 13 = 0 THEN 'in_play' ELSE 'complete' END AS status, m % 13 <> 0 AS status_agreement FROM matches0),
long_a AS (SELECT match_ref, player_id AS alpha_id, unnest([{'stat': 'goals', 'v': goals}, {'stat': 'shots', 'v': shots}, {'stat': 'shots_on_target', 'v': shots_on_target}], recursive := true) FROM sa),
long_b AS (SELECT match_ref, player_id AS beta_id, unnest([{'stat': 'goals', 'v': goals}, {'stat': 'shots', 'v': shots}, {'stat': 'shots_on_target', 'v': shots_on_target}], recursive := true) FROM sb),
stats AS (
  SELECT p.match_ref, part, place, canonical_name, p.alpha_id, p.beta_id, s.stat, coalesce(x.v, y.v)::INT AS value, x.v IS NULL OR y.v IS NULL OR x.v = y.v AS agreement, x.v::INT AS alpha_value, y.v::INT AS beta_value
  FROM players p, (SELECT unnest(['goals', 'shots', 'shots_on_target']) AS stat) s LEFT JOIN long_a x ON x.match_ref = p.match_ref AND x.alpha_id = p.alpha_id AND x.stat = s.stat
  LEFT JOIN long_b y ON y.match_ref = p.match_ref AND y.beta_id = p.beta_id AND y.stat = s.stat WHERE x.v IS NOT NULL OR y.v IS NOT NULL),
keyed AS (SELECT *, market_type || coalesce('@' || line::VARCHAR, '') AS mref, concat_ws('|', market_type || coalesce('@' || line::VARCHAR, ''), player_ref) AS mkey FROM markets),
lone AS (SELECT match_ref, mref, mkey, min(place) AS place, any_value(method) AS method, list_sort(list_distinct(list(alpha_code) FILTER (alpha_code IS NOT NULL))) AS alpha_codes,
  list_sort(list_distinct(list(beta_code) FILTER (beta_code IS NOT NULL))) AS beta_codes FROM keyed WHERE status = 'unmatched' GROUP BY 1, 2, 3),
found AS (
  SELECT match_ref, 0 AS step, 0 AS part, CASE role WHEN 'home' THEN 0 ELSE 1 END AS place, 'value_conflict' AS category, 'team' AS entity_type, role || ' team' AS entity_ref, 'high' AS severity,
         @reason:team@ AS reason, @action:team@ AS suggested_action, alpha_id, beta_id, @values:alpha_name:beta_name@ AS competing_values, NULL AS resolution, role AS target
  FROM teams WHERE tier = 0
  UNION ALL SELECT match_ref, 1, part, place, CASE kind WHEN 'provisional' THEN 'provisional_mapping' WHEN 'placeholder' THEN 'data_quality' ELSE 'entity_unmatched' END, 'player', canonical_name,
         CASE WHEN kind IN ('provisional', 'placeholder') THEN 'medium' ELSE 'low' END,
         CASE kind WHEN 'provisional' THEN @reason:provisional@ WHEN 'placeholder' THEN @reason:placeholder@ WHEN 'alpha_only' THEN @reason:alpha_only@ ELSE @reason:beta_only@ END,
         CASE kind WHEN 'provisional' THEN @action:provisional@ WHEN 'placeholder' THEN @action:placeholder@ WHEN 'alpha_only' THEN @action:alpha_only@ ELSE @action:beta_only@ END,
         alpha_id, beta_id, CASE kind WHEN 'provisional' THEN @values:alpha_name:beta_name@ END, NULL, coalesce(alpha_id, '-') || '|' || coalesce(beta_id, '-')
  FROM (SELECT *, CASE WHEN status = 'provisional' THEN 'provisional' WHEN method = 'placeholder' THEN 'placeholder' WHEN beta_id IS NULL THEN 'alpha_only' ELSE 'beta_only' END AS kind FROM players WHERE status <> 'matched') p
  UNION ALL SELECT match_ref, 2, 0, place, 'market_unmatched', 'market', mref, 'low', @reason:market@, @action:market@, NULL, NULL, to_json({'alpha': coalesce(alpha_codes, []), 'beta': coalesce(beta_codes, [])})::VARCHAR, NULL, mkey FROM lone
  UNION ALL SELECT match_ref, 3, 0, 0, 'value_conflict', 'match', 'final score', 'high', @reason:score@, @action:score@, NULL, NULL, to_json({'alpha_result': {'home': alpha_home, 'away': alpha_away}, 'beta_result': {'home': beta_home, 'away': beta_away},
         'alpha_goal_tally': {'home': alpha_tally_home, 'away': alpha_tally_away}, 'beta_goal_tally': {'home': beta_tally_home, 'away': beta_tally_away}})::VARCHAR, @choice:score@, 'score' FROM score WHERE NOT agreement
  UNION ALL SELECT match_ref, 4, 0, 0, 'value_conflict', 'match', 'kickoff', 'high', @reason:kickoff@, @action:kickoff@, NULL, NULL, @values:alpha_kickoff:beta_kickoff@, @choice:kickoff@, 'kickoff' FROM matches WHERE NOT kickoff_agreement
  UNION ALL SELECT match_ref, 5, part, place * 10 + CASE stat WHEN 'goals' THEN 1 WHEN 'shots' THEN 2 ELSE 3 END, 'value_conflict', 'player_stat', canonical_name || ' · ' || stat, 'medium', @reason:stat@, @action:stat@, alpha_id, beta_id,
         @values:alpha_value:beta_value@, @choice:stat@, coalesce(alpha_id, '-') || '|' || coalesce(beta_id, '-') || '|' || stat FROM stats WHERE NOT agreement
  UNION ALL SELECT match_ref, 6, 0, place, 'price_divergence', 'selection', mref || ' · ' || selection, 'info', @reason:price@, @action:price@, NULL, NULL, @values:alpha_price:beta_price@, NULL, mkey || '|' || selection FROM keyed WHERE NOT agreement),
reviews AS (SELECT *, 'R' || CASE WHEN k < 100 THEN lpad(k::VARCHAR, 2, '0') ELSE k::VARCHAR END AS review_id FROM (SELECT *, row_number() OVER (PARTITION BY match_ref ORDER BY step, part, place, entity_ref, target) AS k FROM found))"""



def _said(mark: re.Match) -> str:
    """What stands for a mark: a sentence that the query has too, or the feeds' competing values as JSON."""
    kind, *names = mark[1].split(":")
    if kind == "values":
        return f"to_json({{'alpha': {names[0]}, 'beta': {names[1]}}})::VARCHAR"
    return sentence_sql({"reason": REASONS, "action": ACTIONS, "choice": CHOICES}[kind][names[0]])


FEEDS = re.sub(r"@([a-z_:]+)@", _said, TEMPLATE)
_WITH = f"WITH RECURSIVE {FEEDS}"

SQL: dict[str, str] = {
    "rec_teams": f"""{_WITH} SELECT match_ref, role, alpha_name AS canonical_name, alpha_id, beta_id, alpha_name, beta_name, CASE WHEN tier > 0 THEN 'matched' ELSE 'provisional' END AS status, CASE WHEN tier > 0 THEN tier END AS confidence,
      CASE tier WHEN 1.0 THEN 'exact_after_normalization' WHEN 0.9 THEN 'name_prefix' ELSE 'no_name_match' END AS method FROM teams""",
    "rec_candidates": f"{_WITH} SELECT * FROM candidates",
    "rec_players": f"{_WITH} SELECT * FROM players",
    "rec_markets": f"{_WITH} SELECT * FROM markets",
    "rec_score": f"{_WITH} SELECT * FROM score",
    "rec_match": f"{_WITH} SELECT * FROM matches",
    "rec_stats": f"{_WITH} SELECT * FROM stats",
    "rec_reviews": f"{_WITH} SELECT match_ref, review_id, category, entity_type, entity_ref, severity, reason, suggested_action, alpha_id, beta_id, competing_values, resolution, target FROM reviews",
    "rec_summary": f"{_WITH} SELECT 'review' AS kind, severity AS value, count(*) AS n FROM reviews GROUP BY 2 UNION ALL SELECT 'player', status, count(*) FROM players GROUP BY 2",
    "rec_canonical": f"""{_WITH}, r AS (SELECT match_ref, count(*) AS reviews, count(*) FILTER (step = 0) AS t, count(*) FILTER (step = 1) AS p, count(*) FILTER (step = 5) AS s, bool_or(step = 3) AS sc, bool_or(step = 4) AS k FROM reviews GROUP BY 1),
      q AS (SELECT match_ref, count(*) AS markets, count(*) FILTER (status = 'unmatched' OR NOT agreement) AS marked FROM markets GROUP BY 1)
      SELECT match_ref, 2 AS teams, (SELECT count(*) FROM players p WHERE p.match_ref = m.match_ref)::INT AS players, q.markets::INT AS markets, (SELECT count(*) FROM stats s WHERE s.match_ref = m.match_ref)::INT AS stats, r.reviews::INT AS reviews,
        r.t::INT AS teams_to_review, r.p::INT AS players_to_review, q.marked::INT AS markets_to_review, r.s::INT AS stats_to_review, r.sc AS score_to_review, r.k AS kickoff_to_review
      FROM matches m JOIN r USING (match_ref) JOIN q USING (match_ref)""",
}
