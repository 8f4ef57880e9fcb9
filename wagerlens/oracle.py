"""The catalogue's queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from . import oracle_feeds
from .config import PHASES
from .operators.legs import FACTS

ORDER = "placed_at, row_key, version, ggr"

#: raw: the tables as legs.
RAW = r"""
raw0 AS (
  SELECT (CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 50 ELSE o_custkey END)::VARCHAR AS uid, o_orderdate::TIMESTAMP AS placed_at,
         o_orderdate::TIMESTAMP + to_minutes(((l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 12000 - 600)::BIGINT) AS event_at,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'SIMPLE' ELSE 'COMBINED' END AS bet_type,
         l_suppkey::BIGINT AS match_id, s_name AS fixture, p_brand AS competition, p_type AS market, r_name AS player,
         l_returnflag || l_linestatus AS selection, cn.n_name AS management_unit,
         CASE WHEN o_custkey % 37 <> 0 THEN o_orderstatus END AS currency,
         1000 + (2 * round(l_extendedprice * 100)::BIGINT + 100 * l_quantity::BIGINT) // (200 * l_quantity::BIGINT) AS milli,
         o_totalprice::DECIMAL(18,2) AS turnover,
         (o_totalprice::DECIMAL(18,2) * (l_tax::DECIMAL(4,2) - l_discount::DECIMAL(4,2)))::DECIMAL(18,2) AS ggr,
         l_orderkey::BIGINT * 16 + l_linenumber AS version
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey
  JOIN region ON sn.n_regionkey = r_regionkey),
raw AS (
  SELECT *, (milli * 0.001::DECIMAL(4,3))::DECIMAL(10,3) AS price, (ggr * 0.08::DECIMAL(3,2))::DECIMAL(18,2) AS net_revenue,
         md5(concat_ws(chr(31), uid, strftime(placed_at, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((epoch_ms(placed_at) % 1000)::VARCHAR, 3, '0'), bet_type, match_id::VARCHAR, market, player, selection,
                       (milli * 0.001::DECIMAL(4,3))::DECIMAL(10,3)::VARCHAR)) AS row_key
  FROM raw0)"""

#: legs: raw with the derived columns; slips: one row a betslip.
LEGS = RAW + r""",
legs0 AS (
  SELECT *, upper(trim(management_unit)) AS region, contains(upper(management_unit), 'RETA') AS is_brand_unit,
         CASE WHEN regexp_full_match(uid, '[0-9]+') THEN 'numeric' ELSE 'string' END AS uid_format, market AS market_normalised,
         (epoch_us(placed_at) - epoch_us(event_at)) / 60000000.0::DOUBLE AS minutes_to_kickoff, placed_at > event_at AS is_inplay,
         uid || '|' || strftime(placed_at, '%Y%m%d%H%M%S') AS base_id
  FROM raw),
legs AS (
  SELECT *, bet_type = 'SIMPLE' AND count(*) OVER (PARTITION BY base_id) > 1 AS had_key_collision,
         CASE WHEN bet_type = 'SIMPLE' THEN 1 ELSE count(*) OVER (PARTITION BY base_id, bet_type) END AS leg_count,
         CASE WHEN bet_type = 'SIMPLE' THEN base_id || '#' || (row_number() OVER (PARTITION BY base_id, bet_type ORDER BY placed_at, row_key, version, ggr) - 1) ELSE base_id END AS betslip_id
  FROM legs0),
slips AS (
  SELECT betslip_id, f.*, currency, turnover, ggr, net_revenue FROM (
    SELECT betslip_id, unnest([first({'uid': uid, 'placed_at': placed_at, 'bet_type': bet_type, 'region': region, 'uid_format': uid_format} ORDER BY placed_at, row_key, version, ggr)]) AS f,
           first(currency ORDER BY placed_at, row_key, version, ggr) FILTER (currency IS NOT NULL) AS currency, first(turnover ORDER BY placed_at, row_key, version, ggr) AS turnover,
           first(ggr ORDER BY placed_at, row_key, version, ggr) AS ggr, first(net_revenue ORDER BY placed_at, row_key, version, ggr) AS net_revenue
    FROM legs GROUP BY betslip_id)),
counted AS (SELECT betslip_id, count(*) AS legs, bool_or(had_key_collision) AS had_key_collision FROM legs GROUP BY betslip_id),
betslips AS (SELECT slips.*, counted.legs, counted.had_key_collision FROM slips JOIN counted USING (betslip_id))"""

#: priced: legs with the value of their prices.
PRICED = LEGS + r""",
scope AS (
  SELECT *, last(price ORDER BY placed_at, row_key, version, ggr) OVER g AS lp, last(uid ORDER BY placed_at, row_key, version, ggr) OVER g AS lu,
         last(milli ORDER BY placed_at, row_key, version, ggr) OVER g AS lm, count(*) OVER g AS size, min(price) OVER g < max(price) OVER g AS moves,
         row_number() OVER (PARTITION BY match_id, market_normalised, player, selection ORDER BY placed_at DESC, row_key DESC, version DESC, ggr DESC) AS from_end
  FROM legs WHERE NOT is_inplay AND price > 1
  WINDOW g AS (PARTITION BY match_id, market_normalised, player, selection)),
valued AS (
  SELECT *, from_end > 1 AS value_eligible, CASE WHEN from_end > 1 THEN (2 * milli * 1000000 + lm) // (2 * lm) - 1000000 END AS value_micro FROM scope),
priced AS (
  SELECT *, CASE WHEN value_eligible THEN lp END AS reference_price, CASE WHEN value_micro IS NOT NULL THEN greatest(least(value_micro, 500000), -500000) END AS value_winsorised,
         value_eligible AND uid = lu AS reference_is_own_bet, size AS group_leg_count, moves AS group_price_moves
  FROM valued)"""

UNITS = PRICED + r""",
units0 AS (
  SELECT uid, match_id, market_normalised, player, selection, count(*) AS legs, sum(value_winsorised)::BIGINT AS value_sum,
         sum(value_winsorised)::BIGINT / count(*) / 1e6 AS mean_value, sum(turnover) AS stake,
         first(currency ORDER BY currency IS NULL, placed_at, row_key, version, ggr) AS currency, sum(value_winsorised) > 0 AS beat
  FROM priced WHERE value_eligible AND NOT reference_is_own_bet GROUP BY 1, 2, 3, 4, 5),
units AS (SELECT *, (2000 * value_sum + legs - (((2000 * value_sum + legs) % (2 * legs) + 2 * legs) % (2 * legs))) // (2 * legs) AS mean_nano FROM units0),
per_currency AS (
  SELECT uid, currency, count(*) AS n, sum(stake) AS stake, sum(stake::DECIMAL(18,2) * mean_nano::DECIMAL(12,0)) AS weighted FROM units WHERE currency IS NOT NULL GROUP BY 1, 2),
dominant AS (
  SELECT uid, arg_min(currency, (-n, currency)) AS dominant_currency,
         arg_min(CASE WHEN stake > 0 THEN weighted::DOUBLE / stake::DOUBLE / 1e9 END, (-n, currency)) AS swv, count(*) > 1 AS multi_currency
  FROM per_currency GROUP BY uid),
context AS (
  SELECT uid, count(DISTINCT betslip_id) AS betslips, count(*) AS legs, min(placed_at) AS first_seen, max(placed_at) AS last_seen,
         first(region ORDER BY placed_at, row_key, version, ggr) AS region, first(uid_format ORDER BY placed_at, row_key, version, ggr) AS uid_format,
         count(DISTINCT market_normalised) AS distinct_markets, bool_or(had_key_collision) AS has_same_second_clusters,
         count(*) FILTER (minutes_to_kickoff BETWEEN -60 AND 0) / count(*) AS late_share, count(*) FILTER (is_inplay) / count(*) AS inplay_share,
         count(*) FILTER (bet_type = 'SIMPLE') / count(*) AS simple_share,
         (epoch_us(max(placed_at)) - epoch_us(min(placed_at))) / 86400000000.0::DOUBLE AS span_days
  FROM legs GROUP BY uid),
tops AS (SELECT uid, arg_min(market_normalised, (-n, market_normalised)) AS top_market FROM (SELECT uid, market_normalised, count(*) AS n FROM legs GROUP BY 1, 2) GROUP BY uid),
windows AS (
  SELECT u.*, d.dominant_currency, d.swv, d.multi_currency, c.* EXCLUDE (uid), t.top_market
  FROM (SELECT uid, count(*) AS priced_units, count(*) FILTER (beat) AS beats, sum(mean_nano)::BIGINT / count(*) / 1e9 AS mean_price_value, count(DISTINCT match_id) AS distinct_fixtures FROM units GROUP BY uid) u
  LEFT JOIN dominant d USING (uid) JOIN context c USING (uid) LEFT JOIN tops t USING (uid)),
scored AS (
  SELECT *, beats / priced_units AS beat_rate,
         round(greatest(least((beats / priced_units + 1.96::DOUBLE * 1.96 / (2 * priced_units) - 1.96::DOUBLE * sqrt((beats / priced_units) * (1 - beats / priced_units) / priced_units + 1.96::DOUBLE * 1.96 / (4.0 * priced_units * priced_units)))
               / (1 + 1.96::DOUBLE * 1.96 / priced_units), 1.0), 0.0), 12) AS wilson_lb
  FROM windows WHERE betslips >= 10)"""

#: log: versions of legs.
LOG = RAW + r""",
log AS (
  SELECT * EXCLUDE (raw_n), 'placement' AS event_kind FROM (SELECT *, 0 AS raw_n FROM raw)
  UNION ALL BY NAME SELECT *, 'placement' AS event_kind FROM raw WHERE version % 50 = 7
  UNION ALL BY NAME SELECT * REPLACE ((turnover + 1)::DECIMAL(18,2) AS turnover, version + 500 AS version), 'settlement' AS event_kind FROM raw WHERE version % 1000 = 17
  UNION ALL BY NAME SELECT * REPLACE (turnover AS ggr, (turnover * 0.08::DECIMAL(3,2))::DECIMAL(18,2) AS net_revenue, version + 1000000000000 AS version), 'reversal' AS event_kind FROM raw WHERE version % 10 = 3),
now AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY version DESC, CASE event_kind WHEN 'placement' THEN 1 WHEN 'settlement' THEN 2 WHEN 'reversal' THEN 3 ELSE 0 END DESC, ggr DESC, net_revenue DESC, turnover DESC) AS rn FROM log)
  WHERE rn = 1)"""

TAGGED = RAW + r""",
tagged AS (
  SELECT *, 'one' AS source_file FROM raw WHERE version % 3 < 2 UNION ALL BY NAME SELECT *, 'two' AS source_file FROM raw WHERE version % 3 > 0
  UNION ALL BY NAME SELECT *, 'one' AS source_file FROM raw WHERE version % 3 < 2 AND version % 11 = 0),
kinds AS (SELECT row_key, version, event_at, ggr, turnover, currency, management_unit, fixture, competition, source_file, count(*) AS n FROM tagged GROUP BY ALL)"""


def _ratio(part: str, whole: str) -> str:
    return f"((({part})::HUGEINT * 20000 + ({whole})) // (2 * ({whole})))::DOUBLE / 10000.0::DOUBLE"


def _breakdown(source: str, key: str, label: str | None = None, with_: str = LEGS, n: int = 15) -> str:
    return f"""WITH {with_},
head AS (SELECT {key} AS k FROM {source} GROUP BY 1 ORDER BY count(*) DESC, {key} ASC NULLS LAST LIMIT {n}),
dealt AS (SELECT s.*, CASE WHEN h.k IS NOT NULL THEN s.{key}::VARCHAR ELSE '__other__' END AS bucket FROM {source} s LEFT JOIN head h ON s.{key} = h.k),
counts AS (SELECT bucket, count(*) AS legs, count(DISTINCT betslip_id) AS betslips, min(CASE WHEN bucket = '__other__' THEN bucket ELSE {label or key}::VARCHAR END) AS label FROM dealt GROUP BY 1),
sums AS (SELECT bucket, currency, sum(turnover)::DOUBLE AS turnover FROM dealt GROUP BY 1, 2)
SELECT c.bucket AS key, c.label, c.legs, {_ratio("c.legs", "(SELECT count(*) FROM dealt)")} AS share, c.betslips, s.currency, s.turnover
FROM counts c JOIN sums s ON c.bucket = s.bucket"""


def _phase_case() -> str:
    out = []
    for label, low, high in PHASES:
        tests = [] if low is None else [f"m {'>' if low >= 0 else '>='} {low}"]
        tests += [] if high is None else [f"m {'<' if high < 0 else '<='} {high}"]
        out.append(f"WHEN {' AND '.join(tests)} THEN '{label}'")
    return "CASE " + " ".join(out) + " END"


PHASED = LEGS + f""",
phased AS (SELECT *, {_phase_case()} AS phase FROM (SELECT *, minutes_to_kickoff AS m FROM legs)),
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{label}', {str(not (low is not None and low >= 0)).lower()})" for i, (label, low, _) in enumerate(PHASES))}) t(position, phase, is_pre_match))"""

MOVES = LEGS + r""",
moves0 AS (
  SELECT match_id, market_normalised, player, selection, count(*) AS legs, first(price ORDER BY placed_at, row_key, version, ggr) AS first_price, last(price ORDER BY placed_at, row_key, version, ggr) AS last_price,
         first(fixture ORDER BY placed_at, row_key, version, ggr) AS fixture, first(event_at ORDER BY placed_at, row_key, version, ggr) AS kickoff, sum(turnover) AS turnover,
         count(DISTINCT currency) AS nc, min(currency) AS currency, count(DISTINCT uid) AS distinct_uids
  FROM legs WHERE NOT is_inplay AND price > 1 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
moves1 AS (SELECT *, (1.0::DOUBLE / last_price::DOUBLE) / (1.0::DOUBLE / first_price::DOUBLE) - 1.0 AS mv FROM moves0),
moves AS (SELECT *, CASE WHEN mv > 0 THEN 'steamer' ELSE 'drifter' END AS direction, abs(mv) >= 0.25 AND distinct_uids >= 2 AS is_sharp_move FROM moves1)"""

POPULATIONS = LEGS + r""",
units AS (
  SELECT 'uid_turnover:' || currency AS population, sum(turnover) AS v FROM betslips WHERE currency IN (SELECT currency FROM betslips GROUP BY 1 HAVING count(*) >= 100) GROUP BY currency, uid
  UNION ALL SELECT 'uid_betslips', count(*) FROM betslips GROUP BY uid
  UNION ALL SELECT 'fixture_legs', count(*) FROM legs GROUP BY match_id
  UNION ALL SELECT 'fixture_turnover:' || currency, sum(turnover) FROM legs
    WHERE currency IN (SELECT currency FROM legs WHERE currency IS NOT NULL GROUP BY 1 HAVING count(DISTINCT match_id) >= 20) GROUP BY currency, match_id),
ranked AS (
  SELECT population, v, row_number() OVER w AS r, count(*) OVER (PARTITION BY population) AS n, sum(v) OVER (PARTITION BY population) AS total,
         sum(v) OVER (PARTITION BY population ORDER BY v ROWS UNBOUNDED PRECEDING) AS c
  FROM units WINDOW w AS (PARTITION BY population ORDER BY v))"""

CLUSTERS = LEGS + r""",
clusters AS (
  SELECT uid, placed_at, count(DISTINCT betslip_id) AS cluster_size, count(*) AS legs, count(DISTINCT match_id) AS fixtures, count(DISTINCT market_normalised) AS markets,
         first(region ORDER BY placed_at, row_key, version, ggr) AS region, first(uid_format ORDER BY placed_at, row_key, version, ggr) AS uid_format,
         CASE WHEN count(DISTINCT currency) <= 1 THEN min(currency) END AS currency, CASE WHEN count(DISTINCT currency) <= 1 THEN sum(turnover)::DOUBLE END AS stake
  FROM legs WHERE had_key_collision GROUP BY uid, placed_at)"""

SPIKES = r"""
days0 AS (SELECT currency, placed_at::DATE AS day, sum(turnover)::DOUBLE AS t, (sum(turnover) * 100)::BIGINT AS c, count(*) AS betslips FROM betslips WHERE currency IS NOT NULL GROUP BY 1, 2),
days AS (SELECT * FROM (SELECT *, max(betslips) OVER (PARTITION BY currency) AS busiest FROM days0) WHERE betslips >= busiest * 0.01),
mids AS (SELECT currency, (2 * median(c))::BIGINT AS twice FROM days GROUP BY 1 HAVING count(*) >= 10),
mads AS (SELECT currency, twice / 200.0::DOUBLE AS med, median(abs(2 * c - twice)) / 200.0::DOUBLE AS mad FROM days JOIN mids USING (currency) GROUP BY 1, twice HAVING median(abs(2 * c - twice)) > 0),
spikes AS (SELECT currency, day, t AS turnover, betslips, med AS median, mad, med + 2.0 * mad AS threshold, round(t / (med + 2.0 * mad), 3) AS excess_ratio FROM days JOIN mads USING (currency) WHERE t > med + 2.0 * mad)"""

EXPOSURE = r"""
fx AS (SELECT currency, match_id, sum(turnover) AS ft, first(fixture ORDER BY placed_at, row_key, version, ggr) AS fixture FROM legs WHERE currency IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
cut AS (SELECT currency, quantile_cont(ft::DOUBLE, 0.5) AS cutoff FROM fx GROUP BY 1 HAVING count(*) >= 5),
sel AS (SELECT currency, match_id, market_normalised, player, selection, sum(turnover) AS st, count(*) AS n, count(DISTINCT uid) AS u FROM legs WHERE currency IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY currency, match_id ORDER BY st DESC, market_normalised, player, selection) AS rn FROM sel) WHERE rn = 1),
exposure AS (
  SELECT match_id, fixture, currency, ft::DOUBLE AS fixture_turnover, market_normalised AS market, selection, player AS player_label, st::DOUBLE AS selection_turnover,
         round(st::DOUBLE / ft::DOUBLE, 4) AS share, n AS legs, u AS distinct_uids, u < 2 AS single_actor
  FROM best JOIN fx USING (currency, match_id) JOIN cut USING (currency) WHERE ft::DOUBLE >= cutoff AND ft > 0 AND st::DOUBLE / ft::DOUBLE >= 0.02 AND n >= 1)"""

BACKING = r"""
per_slip AS (
  SELECT l.uid, l.match_id, l.market_normalised, l.player, l.selection, l.betslip_id, count(*) AS n, first(turnover ORDER BY placed_at, row_key, version, ggr) AS stake,
         first(currency ORDER BY placed_at, row_key, version, ggr) AS currency, bool_or(had_key_collision) AS collided
  FROM legs l GROUP BY 1, 2, 3, 4, 5, 6),
a AS (SELECT uid, match_id, market_normalised, player, selection, count(*) AS betslips, sum(stake)::DOUBLE AS stake, count(DISTINCT currency) AS nc, bool_or(collided) AS includes_key_collision FROM per_slip GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3),
b AS (
  SELECT uid, match_id, market_normalised, player, selection, count(*) AS legs, first(fixture ORDER BY placed_at, row_key, version, ggr) AS fixture, first(currency ORDER BY placed_at, row_key, version, ggr) AS cur,
         first(price ORDER BY placed_at, row_key, version, ggr)::DOUBLE AS first_price, last(price ORDER BY placed_at, row_key, version, ggr)::DOUBLE AS last_price,
         (epoch_us(max(placed_at)) - epoch_us(min(placed_at))) / 60000000.0::DOUBLE AS span_minutes
  FROM legs GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT uid, match_id, market_normalised, player, selection, sum(value_winsorised)::BIGINT / count(value_winsorised) / 1e6 AS mv FROM priced GROUP BY 1, 2, 3, 4, 5),
backing AS (
  SELECT a.uid, a.match_id, a.market_normalised, a.player, a.selection, betslips, legs, fixture, CASE WHEN nc <= 1 THEN cur END AS currency, first_price, last_price,
         CASE WHEN nc <= 1 THEN stake END AS stake, round(mv, 9) AS mean_price_value, includes_key_collision, span_minutes
  FROM a JOIN b USING (uid, match_id, market_normalised, player, selection) LEFT JOIN v USING (uid, match_id, market_normalised, player, selection))"""

TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

#: What DuckDB's own accent stripping leaves.
FOLD = "lower(strip_accents(replace(replace(replace(translate({0}, 'ØøĐđŁłð', 'OoDdLld'), 'Þ', 'Th'), 'þ', 'th'), 'ß', 'ss')))"

SQL: dict[str, str] = {
    "universe": f"""WITH {LEGS} SELECT count(*) AS legs, count(DISTINCT betslip_id) AS betslips, count(DISTINCT uid) AS uids, count(DISTINCT match_id) AS fixtures, count(DISTINCT competition) AS competitions,
      count(DISTINCT market_normalised) AS markets, min(placed_at::DATE)::VARCHAR AS first_day, max(placed_at::DATE)::VARCHAR AS last_day, count(*) FILTER (is_inplay) AS inplay_legs FROM legs""",
    "dedup_funnel": f"WITH {TAGGED} SELECT source_file, sum(n)::BIGINT AS rows_raw, count(*) AS rows_after, sum(n)::BIGINT - count(*) AS removed FROM kinds GROUP BY 1",
    "cross_source_overlap": f"""WITH {TAGGED} SELECT count(*) AS overlap FROM (SELECT 1 FROM kinds GROUP BY row_key, version, event_at, ggr, turnover, currency, management_unit, fixture, competition HAVING count(DISTINCT source_file) > 1)""",
    "drop_repeats": f"""WITH {TAGGED} SELECT source_file, count(*) AS n FROM (SELECT min(source_file) AS source_file FROM kinds GROUP BY row_key, version, event_at, ggr, turnover, currency, management_unit, fixture, competition) GROUP BY 1""",
    "betslip_frame": f"""WITH {LEGS} SELECT betslip_id, uid, {TIME.format("placed_at")} AS placed_at, bet_type, region, currency, turnover::DOUBLE AS turnover, ggr::DOUBLE AS ggr, net_revenue::DOUBLE AS net_revenue, uid_format, legs, had_key_collision FROM betslips""",
    "money_by_currency": f"WITH {LEGS} SELECT currency, count(*) AS n_rows, sum(turnover)::DOUBLE AS amount FROM betslips GROUP BY 1",
    "inflation_by_currency": f"""WITH {LEGS}, l AS (SELECT currency, sum(turnover) AS t FROM legs WHERE currency IS NOT NULL GROUP BY 1), b AS (SELECT currency, sum(turnover) AS t FROM betslips WHERE currency IS NOT NULL GROUP BY 1)
      SELECT currency, l.t::DOUBLE AS leg_turnover, b.t::DOUBLE AS betslip_turnover, l.t::DOUBLE / b.t::DOUBLE AS inflation FROM l JOIN b USING (currency) WHERE b.t > 0""",
    "book_summary": f"""WITH {LEGS} SELECT currency, count(*) AS betslips, sum(turnover)::DOUBLE AS turnover, sum(ggr)::DOUBLE AS ggr, sum(ggr)::DOUBLE / sum(turnover)::DOUBLE AS margin, sum(turnover)::DOUBLE / count(*) AS mean_stake FROM betslips WHERE currency IS NOT NULL GROUP BY 1""",
    "by_market": _breakdown("legs", "market_normalised"),
    "by_competition": _breakdown("legs", "competition"),
    "by_fixture": _breakdown("legs", "match_id", "fixture"),
    "by_region": _breakdown("betslips", "region"),
    "by_bet_type": _breakdown("betslips", "bet_type"),
    "by_selection": _breakdown("sel_legs", "selection_key", "selection_label", LEGS + """,
top_markets AS (SELECT market_normalised FROM legs GROUP BY 1 ORDER BY count(*) DESC, market_normalised LIMIT 5),
per_market AS (SELECT market_normalised, count(DISTINCT player) AS np FROM legs GROUP BY 1),
sel_legs AS (SELECT legs.*, market_normalised || '|' || player || '|' || selection AS selection_key, CASE WHEN np > 1 THEN player || ' - ' || selection ELSE selection END AS selection_label
  FROM legs SEMI JOIN top_markets USING (market_normalised) JOIN per_market USING (market_normalised))"""),
    "by_player": _breakdown("named", "player_name", None, LEGS + """,
labels AS (SELECT market, min('Shots on target ' || array_to_string(list_transform(string_split(player, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' ')) AS lo, max('Shots on target ' || array_to_string(list_transform(string_split(player, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' ')) AS hi FROM legs GROUP BY 1),
prefix AS (SELECT market, rtrim(lo[1:coalesce(list_max(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0)]) AS pre FROM labels),
named0 AS (SELECT legs.*, trim(substr('Shots on target ' || array_to_string(list_transform(string_split(player, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' '), len(pre) + 1)) AS player_name FROM legs JOIN prefix USING (market)),
named AS (SELECT * FROM named0 WHERE len(player_name) BETWEEN 1 AND 60)"""),
    "player_coverage": f"""WITH {LEGS},
labels AS (SELECT market, min('Shots on target ' || array_to_string(list_transform(string_split(player, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' ')) AS lo, max('Shots on target ' || array_to_string(list_transform(string_split(player, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' ')) AS hi FROM legs GROUP BY 1),
prefix AS (SELECT market, rtrim(lo[1:coalesce(list_max(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0)]) AS pre FROM labels),
named AS (SELECT nullif(trim(substr('Shots on target ' || array_to_string(list_transform(string_split(player, ' '), lambda t: upper(t[1]) || lower(t[2:])), ' '), len(pre) + 1)), '') AS player_name FROM legs JOIN prefix USING (market))
SELECT count(*) AS player_centric_legs, count(*) AS template_legs, 0::BIGINT AS option_legs, count(player_name) AS named_legs, count(DISTINCT player_name) AS names FROM named""",
    "breakdowns_single_pass": f"""WITH {LEGS}, g AS (
      SELECT unnest([{{'dimension': 'market_normalised', 'key': market_normalised, 'label': market_normalised}}, {{'dimension': 'competition', 'key': competition, 'label': competition}}, {{'dimension': 'match_id', 'key': match_id::VARCHAR, 'label': fixture}},
        {{'dimension': 'region', 'key': region, 'label': region}}, {{'dimension': 'bet_type', 'key': bet_type, 'label': bet_type}}, {{'dimension': 'player', 'key': player, 'label': player}}, {{'dimension': 'selection', 'key': selection, 'label': selection}}], recursive := true),
        betslip_id, currency, turnover FROM legs),
      h AS (SELECT dimension, key FROM (SELECT dimension, key, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, key) AS k FROM g GROUP BY 1, 2) WHERE k <= 15),
      b AS (SELECT g.dimension, coalesce(h.key, '__other__') AS key, CASE WHEN h.key IS NULL THEN '__other__' ELSE g.label END AS label, betslip_id, currency, turnover FROM g LEFT JOIN h ON g.dimension = h.dimension AND g.key = h.key),
      n AS (SELECT dimension, key, count(DISTINCT betslip_id) AS betslips FROM b GROUP BY 1, 2)
      SELECT b.dimension, b.key, min(label) AS label, currency, count(*) AS legs, any_value(n.betslips) AS betslips, sum(turnover)::DOUBLE AS turnover FROM b JOIN n ON b.dimension = n.dimension AND b.key = n.key GROUP BY b.dimension, b.key, currency""",
    "phases": f"""WITH {PHASED} SELECT position, names.phase, is_pre_match, count(row_key) AS legs, count(DISTINCT betslip_id) AS betslips, {_ratio("count(row_key)", "(SELECT count(*) FROM legs)")} AS share FROM names LEFT JOIN phased ON names.phase = phased.phase GROUP BY 1, 2, 3""",
    "phase_money": f"WITH {PHASED} SELECT phase, currency, count(*) AS n_rows, sum(turnover)::DOUBLE AS amount FROM phased WHERE phase IS NOT NULL GROUP BY 1, 2",
    "daily": f"""WITH {LEGS}, d AS (SELECT placed_at::DATE AS day, count(*) AS betslips, sum(legs)::BIGINT AS legs FROM betslips GROUP BY 1) SELECT day::VARCHAR AS day, betslips, legs, betslips >= max(betslips) OVER () * 0.01 AS in_operating_period FROM d""",
    "daily_money": f"WITH {LEGS} SELECT placed_at::DATE::VARCHAR AS day, currency, count(*) AS n_rows, sum(turnover)::DOUBLE AS amount FROM betslips GROUP BY 1, 2",
    "monthly": f"""WITH {LEGS}, m AS (SELECT strftime(placed_at, '%Y-%m') AS month, count(*) AS betslips FROM betslips GROUP BY 1) SELECT month, betslips, {_ratio("betslips", "(SELECT count(*) FROM betslips)")} AS share FROM m""",
    "data_quality": f"""WITH {LEGS} SELECT count(*) AS legs, count(DISTINCT betslip_id) AS betslips, count(*) FILTER (contains(market, '{{')) AS placeholder_market_legs, count(*) FILTER (currency IS NULL) AS unresolved_currency_legs,
      count(*) FILTER (placed_at IS NULL) AS unparsed_dates, count(*) FILTER (had_key_collision) AS collision_legs, count(*) FILTER (bet_type = 'SIMPLE' AND leg_count > 1) AS simple_with_multiple_legs,
      count(*) FILTER (uid_format = 'string') AS string_uid_legs, count(*) FILTER (is_brand_unit) AS brand_unit_legs, count(*) FILTER (is_inplay) AS inplay_legs, count(*) FILTER (is_inplay) / count(*) AS inplay_share FROM legs""",
    "price_reference": f"""WITH {PRICED} SELECT match_id, market_normalised, count(*) AS legs, sum(value_micro)::BIGINT AS value_sum, sum(value_winsorised)::BIGINT AS winsorised_sum, min(reference_price)::DOUBLE AS low_reference,
      max(reference_price)::DOUBLE AS high_reference, count(*) FILTER (reference_is_own_bet) AS own, sum(group_leg_count)::BIGINT AS group_legs, count(*) FILTER (group_price_moves) AS moving FROM priced WHERE value_eligible GROUP BY 1, 2""",
    "price_coverage": f"""WITH {PRICED}, g AS (SELECT count(*) AS n, min(price) < max(price) AS moves FROM priced GROUP BY match_id, market_normalised, player, selection),
      a AS (SELECT count(*) AS pre_match_legs, count(*) FILTER (value_eligible) AS eligible_legs, count(*) FILTER (reference_is_own_bet) AS reference_from_same_uid, count(*) FILTER (value_eligible AND NOT reference_is_own_bet) AS reference_from_other_uid,
        count(*) FILTER (value_winsorised > 0) AS beats FROM priced)
      SELECT a.*, (SELECT count(*) FROM legs WHERE is_inplay) AS inplay_legs_excluded, (SELECT count(*) FROM g) AS groups_total, (SELECT count(*) FROM g WHERE moves) AS groups_with_variation,
        (SELECT count(*) FROM g WHERE n >= 5) AS groups_for_movement, beats / eligible_legs AS population_beat_rate FROM a""",
    "price_movement": f"""WITH {MOVES} SELECT match_id, market_normalised, player, selection, legs, first_price::DOUBLE AS first_price, last_price::DOUBLE AS last_price, fixture, {TIME.format("kickoff")} AS kickoff,
      CASE WHEN nc <= 1 THEN turnover::DOUBLE END AS turnover, CASE WHEN nc <= 1 THEN currency END AS currency, distinct_uids, round(mv, 9) AS implied_prob_move, direction, is_sharp_move FROM moves""",
    "steamers": f"""WITH {MOVES} SELECT match_id, market_normalised, player, selection, legs, round(mv, 9) AS implied_prob_move, is_sharp_move FROM moves WHERE is_sharp_move AND direction = 'steamer' ORDER BY mv DESC, match_id, market_normalised, player, selection LIMIT 25""",
    "drifters": f"""WITH {MOVES} SELECT match_id, market_normalised, player, selection, legs, round(mv, 9) AS implied_prob_move, is_sharp_move FROM moves WHERE is_sharp_move AND direction = 'drifter' ORDER BY mv, match_id, market_normalised, player, selection LIMIT 25""",
    "value_histogram": f"""WITH {PRICED}, e AS (SELECT unnest([-1000, -500, -250, -100, -50, -10, 0, 10, 50, 100, 250, 500, 1000]) AS x), bins AS (SELECT (row_number() OVER (ORDER BY x) - 1)::INT AS bin, x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM e)
      SELECT bin, lo / 1000.0::DOUBLE AS low, hi / 1000.0::DOUBLE AS high, (SELECT count(*) FROM priced WHERE value_micro IS NOT NULL AND (value_micro >= lo * 1000 OR bin = 0) AND (value_micro < hi * 1000 OR bin = 11)) AS legs FROM bins WHERE hi IS NOT NULL""",
    "gini": f"""WITH {POPULATIONS} SELECT population, n AS n_units, total::DOUBLE AS total, round(2.0 * sum(r * v)::DOUBLE / (n::DOUBLE * total::DOUBLE) - (n::DOUBLE + 1) / n::DOUBLE, 4) AS gini FROM ranked WHERE n >= 2 AND total > 0 GROUP BY population, n, total""",
    "top_shares": f"""WITH {POPULATIONS}, cuts AS (SELECT DISTINCT population, n, total, unnest([{{'cut': 'top_1pct', 'units': greatest(1, round_even(n * 0.01, 0)::BIGINT)}}, {{'cut': 'top_5pct', 'units': greatest(1, round_even(n * 0.05, 0)::BIGINT)}},
      {{'cut': 'top_10pct', 'units': greatest(1, round_even(n * 0.10, 0)::BIGINT)}}, {{'cut': 'top_10_units', 'units': least(10, n)}}]) AS k FROM ranked WHERE n >= 2 AND total > 0)
      SELECT cuts.population, k.cut AS cut, k.units AS units, round(sum(v)::DOUBLE / any_value(cuts.total)::DOUBLE, 4) AS share FROM cuts JOIN ranked r ON r.population = cuts.population AND r.r > cuts.n - k.units GROUP BY 1, 2, 3""",
    "turnover_spikes": f"WITH {LEGS}, {SPIKES} SELECT currency, day::VARCHAR AS day, turnover, betslips, median, mad, threshold, excess_ratio FROM spikes",
    "repeat_backing": f"WITH {PRICED}, {BACKING} SELECT * FROM backing",
    "sharp_moves": f"WITH {MOVES} SELECT direction, count(*) AS moves, sum(legs)::BIGINT AS legs, sum(distinct_uids)::BIGINT AS uids FROM moves WHERE is_sharp_move GROUP BY 1",
    "abnormal_exposure": f"WITH {LEGS}, {EXPOSURE} SELECT * FROM exposure",
    "same_second_clusters": f"WITH {CLUSTERS} SELECT * REPLACE ({TIME.format('placed_at')} AS placed_at) FROM clusters",
    "scoring_units": f"WITH {UNITS} SELECT uid, count(*) AS units, sum(legs)::BIGINT AS legs, sum(value_sum)::BIGINT AS value_sum, count(*) FILTER (beat) AS beats, sum(stake)::DOUBLE AS stake FROM units GROUP BY 1",
    "uid_windows": f"""WITH {UNITS} SELECT uid, priced_units, beats, round(mean_price_value, 9) AS mean_price_value, distinct_fixtures, dominant_currency, round(swv, 9) AS stake_weighted_price_value, multi_currency, betslips, legs,
      {TIME.format("first_seen")} AS first_seen, {TIME.format("last_seen")} AS last_seen, region, uid_format, distinct_markets, has_same_second_clusters, late_share, inplay_share, simple_share, span_days, top_market FROM windows""",
    "dominant_currency": f"WITH {UNITS} SELECT uid, dominant_currency, round(swv, 9) AS stake_weighted_price_value, multi_currency FROM dominant",
    "sharp_scores": f"""WITH {UNITS} SELECT uid, priced_units, beats, beat_rate, round(wilson_lb, 9) AS wilson_lb, round((rank() OVER (ORDER BY wilson_lb) + (count(*) OVER (PARTITION BY wilson_lb) - 1) / 2) / count(*) OVER () * 100, 1) AS score FROM scored""",
    "wilson": """WITH r AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1)
      SELECT l_suppkey, n, hits, round(greatest(least((hits / n + 1.96::DOUBLE * 1.96 / (2 * n) - 1.96::DOUBLE * sqrt((hits / n) * (1 - hits / n) / n + 1.96::DOUBLE * 1.96 / (4.0 * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n), 1.0), 0.0), 9) AS lower_bound FROM r""",
    "binomial_tail": """WITH r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS hits FROM events GROUP BY 1),
      t AS (SELECT user_id, n, hits, CASE WHEN hits <= 0 THEN 1.0::DOUBLE ELSE least(1.0, list_sum(list_transform(range(hits, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.2::DOUBLE) + (n - k) * ln(0.8::DOUBLE))))) END AS p FROM r)
      SELECT user_id, n, hits, round(p, 9) AS p_value FROM t""",
    "bh_fdr": """WITH r AS (SELECT p_partkey, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE * ((p_partkey % 5) / 5.0::DOUBLE) AS p FROM part),
      k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM r), l AS (SELECT max(p) AS lim FROM k WHERE p <= 0.25::DOUBLE * i / n) SELECT p_partkey, coalesce(p <= (SELECT lim FROM l), false) AS fdr_pass FROM r""",
    "collapse_current": f"WITH {LOG} SELECT currency, event_kind, count(*) AS legs, sum(turnover)::DOUBLE AS turnover, sum(ggr)::DOUBLE AS ggr, sum(net_revenue)::DOUBLE AS net_revenue, max(version) AS position FROM now GROUP BY 1, 2",
    "immutable_conflicts": f"""WITH {LOG}, k AS (SELECT row_key, count(*) AS versions, concat_ws(',',
      CASE WHEN count(DISTINCT event_at) > 1 THEN 'event_at' END, CASE WHEN count(DISTINCT currency) > 1 OR count(currency) BETWEEN 1 AND count(*) - 1 THEN 'currency' END, CASE WHEN count(DISTINCT turnover) > 1 THEN 'turnover' END) AS changed FROM log GROUP BY 1)
      SELECT * FROM k WHERE changed <> ''""",
    "stream_position": f"WITH {LOG} SELECT max(version) AS position, count(*) AS rows_stored, count(DISTINCT row_key) AS identities, count(*) - count(DISTINCT row_key) AS pending_supersedence FROM log",
    "fingerprint": f"""WITH {LOG} SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', {", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FACTS)})), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM now""",
    "truncation_report": f"""WITH {CLUSTERS}, s AS (SELECT * FROM clusters ORDER BY cluster_size DESC, legs DESC, uid, placed_at LIMIT 50)
      SELECT count(*) AS total, sum(cluster_size)::BIGINT AS total_bets, (SELECT count(*) FROM s) AS shipped, (SELECT sum(cluster_size)::BIGINT FROM s) AS shipped_bets, count(*) - (SELECT count(*) FROM s) AS omitted FROM clusters""",
    "normalise_text": f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+')) AS word FROM documents), f AS (SELECT doc_id, CASE WHEN word <> '' THEN {FOLD.format("word")} END AS name FROM w)
      SELECT doc_id, count(DISTINCT name) AS names, min(name) AS first_name, max(name) AS last_name, count(name) AS n FROM f GROUP BY 1""",
    "management_units": """WITH u AS (SELECT n_nationkey, unnest(['RETABET ' || n_name, ' reta ' || lower(n_name), n_name || ' RETA', 'C. La Mancha', '  ']) AS unit FROM nation),
      c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(upper(strip_accents(trim(unit))), '^RETABET ', ''), '^RETA ', ''), ' RETA$', '') AS r FROM u)
      SELECT n_nationkey, unit, CASE WHEN r = '' THEN 'UNKNOWN' WHEN r = 'C. LA MANCHA' THEN 'CASTILLA LA MANCHA' ELSE r END AS region, contains(upper(unit), 'RETA') AS is_brand FROM c""",
    "market_names": r"""WITH t AS (SELECT DISTINCT unnest([p_type || ' {PLAYER}', '{goalnr}{ordinal} - ' || p_type || '  x', '{COMPETITOR1}', ' {COMPETITOR2} ', '{a}{b}']) AS raw FROM part),
      c AS (SELECT raw, trim(regexp_replace(regexp_replace(raw, '\{[^}]*\}', '', 'g'), '\s+', ' ', 'g'), ' -:') AS m FROM t)
      SELECT raw, CASE trim(raw) WHEN '{COMPETITOR1}' THEN 'Home-side combo (bet builder)' WHEN '{COMPETITOR2}' THEN 'Away-side combo (bet builder)' ELSE CASE WHEN m = '' THEN 'UNKNOWN' ELSE m END END AS market FROM c""",
    "team_name_tiers": """WITH r AS (SELECT n_nationkey, lower(n_name) AS a FROM nation), f AS (SELECT n_nationkey, a, unnest([a || ' FC', substr(a, 1, 3), a || ' city', upper(a)]) AS b FROM r),
      w AS (SELECT *, list_filter(string_split(lower(a), ' '), lambda t: t NOT IN ('fc', 'afc', 'cf', 'sc')) AS x, list_filter(string_split(lower(b), ' '), lambda t: t NOT IN ('fc', 'afc', 'cf', 'sc')) AS y FROM f)
      SELECT n_nationkey, a, b, CASE WHEN x = y THEN 1.0 WHEN len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda p: NOT (starts_with(p[1], p[2]) OR starts_with(p[2], p[1])))) = 0 THEN 0.9 ELSE 0.0 END::DOUBLE AS tier FROM w""",
    "player_name_tiers": """WITH r AS (SELECT n_nationkey, lower(n_name) || ' silva' AS a FROM nation), f AS (SELECT n_nationkey, a, unnest([array_to_string(list_transform(string_split(a, ' '), lambda t: upper(t[1]) || t[2:]), ' '), upper(substr(a, 1, 1)) || '. Silva', substr(a, 1, 4), 'zz silva']) AS b FROM r),
      w AS (SELECT *, string_split(lower(a), ' ') AS x, string_split(lower(b), ' ') AS y FROM f),
      g AS (SELECT *, rtrim(y[1], '.') AS i FROM w)
      SELECT n_nationkey, a, b, CASE WHEN x = y THEN 1.0 WHEN x[-1] = y[-1] AND len(i) = 1 AND len(list_filter(x[:len(x) - 1], lambda t: starts_with(t, i))) > 0 THEN 0.9 WHEN len(y) = 1 AND starts_with(x[1], y[1]) THEN 0.6 ELSE 0.0 END::DOUBLE AS tier FROM g""",
    "odds_convert": """SELECT p_partkey, (p_partkey % 37)::VARCHAR || '/' || p_size::VARCHAR AS odds, round((p_partkey % 37)::DECIMAL(18,6) / p_size + 1, 4)::DOUBLE AS price FROM part""",
    "market_code_parse": """WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'BTTS' WHEN 1 THEN 'OU_TOTAL_GOALS@' || s_suppkey || '.5' WHEN 2 THEN 'PLAYER_SHOTS_ON@' || s_suppkey || '@1.5' ELSE 'Corners@7' END AS raw FROM supplier)
      SELECT s_suppkey, CASE lower(string_split(raw, '@')[1]) WHEN 'btts' THEN 'btts' WHEN 'ou_total_goals' THEN 'total_goals' WHEN 'player_shots_on' THEN 'player_shots_on_target' ELSE 'unknown' END AS market_type,
        list_filter(string_split(raw, '@')[2:], lambda t: NOT contains(t, '.'))[-1] AS player_source_id, list_filter(string_split(raw, '@')[2:], lambda t: contains(t, '.'))[-1]::DOUBLE AS line, raw FROM c""",
    "price_divergence": f"""WITH {LEGS} SELECT match_id, market_normalised, player, selection, count(*) AS n, min(price)::DOUBLE AS low, max(price)::DOUBLE AS high, max(price) - min(price) < 0.001 AS agreement FROM legs GROUP BY 1, 2, 3, 4""",
    "event_windows": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2""",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
      SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM c GROUP BY 1""",
    "key_findings": f"""WITH {PHASED}, p AS (SELECT position, names.phase, is_pre_match, count(row_key) AS legs FROM names LEFT JOIN phased ON names.phase = phased.phase GROUP BY 1, 2, 3),
      t AS (SELECT sum(legs)::BIGINT AS n, sum(CASE WHEN is_pre_match THEN legs ELSE 0 END)::BIGINT AS pre FROM p), b AS (SELECT phase, legs FROM p ORDER BY legs DESC, position LIMIT 1)
      SELECT {_ratio("pre", "n")} AS pre_match_share, phase AS peak_phase, {_ratio("legs", "(SELECT count(*) FROM legs)")} AS peak_share FROM t, b""",
    "ranked_currencies": f"WITH {LEGS} SELECT currency, count(*) AS n_rows, sum(turnover)::DOUBLE AS amount FROM betslips GROUP BY 1",
    "current_scan": f"""WITH {LOG} SELECT row_key, version, event_kind, ggr::DOUBLE AS ggr, {TIME.format("placed_at")} AS placed_at FROM now WHERE match_id <= 3 AND bet_type = 'SIMPLE'""",
    "table_view": f"""WITH {LEGS}, k AS (SELECT competition, count(*) AS legs, count(DISTINCT betslip_id) AS betslips FROM legs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
      SELECT competition AS key, competition AS label, legs, {_ratio("legs", "(SELECT count(*) FROM legs)")} AS share, betslips FROM k WHERE contains(lower(competition), 'brand#1') ORDER BY legs DESC, competition LIMIT 5""",
    "book_shape": f"""WITH {LOG}, u AS (SELECT median(n) AS m FROM (SELECT count(*) AS n FROM log GROUP BY uid))
      SELECT count(*) AS legs, count(*) FILTER (bet_type = 'SIMPLE') / count(*) AS simple_share, count(*) FILTER (currency = 'EUR') / count(currency) AS eur_share, count(*) FILTER (currency = 'PEN') / count(currency) AS pen_share,
        count(*) FILTER (event_kind = 'reversal') AS reversals, count(*) FILTER (event_kind = 'reversal' AND ggr <> turnover) AS odd_reversals, any_value(m) AS median_legs_per_uid FROM log, u""",
}


def _flagged(q: str) -> str:
    """scored with p-values, the Benjamini-Hochberg mask at q, and flags; tails summed in the log domain."""
    return UNITS + f""",
base AS (SELECT count(*) FILTER (beat) / count(*) AS b FROM units),
tested AS (
  SELECT scored.*, CASE WHEN priced_units >= 20 THEN round(CASE WHEN beats <= 0 THEN 1.0::DOUBLE ELSE least(1.0, list_sum(list_transform(range(beats, priced_units + 1),
    lambda k: exp(lgamma(priced_units + 1) - lgamma(k + 1) - lgamma(priced_units - k + 1) + k * ln(b) + (priced_units - k) * ln(1 - b))))) END, 12) END AS p_value FROM scored, base),
limits AS (SELECT max(p_value) AS p_limit FROM (SELECT p_value, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS i, count(*) OVER () AS n FROM tested WHERE p_value IS NOT NULL) WHERE p_value <= {q}::DOUBLE * i / n),
flags AS (SELECT tested.*, coalesce(p_value <= p_limit, false) AS fdr_pass, coalesce(p_value <= p_limit, false) AND coalesce(swv > 0, false) AS flagged FROM tested, limits)"""


SQL |= {
    "sharp_flags": f"WITH {_flagged('0.9')} SELECT uid, round(p_value, 8) AS p_value, fdr_pass, flagged FROM flags",
    "sharp_report": f"""WITH {_flagged('0.1')} SELECT count(*) AS scored_windows, count(*) FILTER (priced_units >= 20) AS flag_eligible_windows, count(*) FILTER (flagged) AS flagged_windows, count(*) FILTER (p_value <= 0.05) AS flags_under_raw_alpha,
      round_even(count(*) * 0.10, 0)::BIGINT AS flags_under_top_decile, count(*) FILTER (multi_currency) AS multi_currency_windows, median(priced_units)::DOUBLE AS median_units_per_window, (0.1 * count(*) FILTER (flagged))::DOUBLE AS expected_false_discoveries,
      (SELECT count(*) FROM units) AS scoring_units_total, (SELECT sum(legs)::BIGINT FROM units) AS legs_in_scope, (SELECT count(*) FILTER (beat) / nullif(count(*), 0) FROM units) AS baseline_beat_rate FROM flags""",
    "lorenz_points": f"""WITH {POPULATIONS}, steps AS (SELECT *, sum(v) OVER (PARTITION BY population ORDER BY r ROWS UNBOUNDED PRECEDING) AS upto FROM ranked WHERE n >= 2 AND total > 0),
      grid AS (SELECT DISTINCT population, n, total, unnest(range(0, 101)) AS i FROM steps)
      SELECT g.population, g.i AS point, round(g.i / 100, 4) AS p, round(CASE WHEN g.i = 0 THEN 0.0 ELSE ((s.upto - s.v)::DOUBLE + s.v::DOUBLE * (g.i / 100 * g.n - (s.r - 1))) / g.total::DOUBLE END, 6) AS share
      FROM grid g LEFT JOIN steps s ON s.population = g.population AND s.r = CASE WHEN g.i = 0 THEN 1 ELSE (g.i * g.n + 99) // 100 END""",
    "alert_counts": f"""WITH {_flagged('0.1')}, {SPIKES}, {EXPOSURE}, {BACKING},
      pairs AS (SELECT 'sharp' AS section, 'critical' AS severity, count(*) AS alerts FROM flags WHERE flagged UNION ALL SELECT 'exposure', 'serious', count(*) FROM exposure UNION ALL SELECT 'spikes', 'warning', count(*) FROM spikes
        UNION ALL SELECT 'clusters', 'signature', count(*) FROM (SELECT DISTINCT uid, placed_at FROM legs WHERE had_key_collision) UNION ALL SELECT 'repeat_backing', 'signature', count(*) FROM backing)
      SELECT * FROM pairs WHERE alerts > 0""",
}
SQL |= oracle_feeds.SQL
