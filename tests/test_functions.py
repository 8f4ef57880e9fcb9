import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wagerlens.functions import clock, odds, stats, text


def values(spark, data, schema, **columns):
    df = spark.createDataFrame(data, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_management_unit(spark):
    cases = [("RETABET EUSKADI", "EUSKADI"), (" reta Madríd ", "MADRID"), ("CATALUNYA RETA", "CATALUNYA"), ("C. La Mancha", "CASTILLA LA MANCHA"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("RETABET RETA X", "X")]
    got = values(spark, [(a,) for a, _ in cases], "u string", r=text.management_unit(F.col("u")))
    assert [g[0] for g in got] == [w for _, w in cases]


def test_market(spark):
    cases = [("Saves {PLAYER}", "Saves"), ("{goalnr}{ordinal} goal scorer", "goal scorer"), ("{COMPETITOR1}", "Home-side combo (bet builder)"), (" {COMPETITOR2} ", "Away-side combo (bet builder)"), ("{x}", "UNKNOWN"), (None, "UNKNOWN"), ("a  -  b :", "a - b")]
    got = values(spark, [(a,) for a, _ in cases], "m string", r=text.market(F.col("m")))
    assert [g[0] for g in got] == [w for _, w in cases]


def test_names(spark):
    got = values(spark, [("Martin Ødegaard",), ("Julián  ÁLVAREZ",), ("Straße Þór",), ("Kovačíc",)], "n string", r=text.fold_name(F.col("n")))
    assert [g[0] for g in got] == ["martin odegaard", "julian alvarez", "strasse thor", "kovacic"]


def test_exact_accents_agree_with_translation(spark):
    df = spark.createDataFrame([("Čáp Żółw ñandú",)], "n string")
    a, b = df.select(text.strip_accents("n"), text.strip_accents_exact("n")).first()
    assert a.replace("ł", "l") == b.replace("ł", "l")


@pytest.mark.parametrize("a,b,tier", [("Arsenal", "Arsenal FC", 1.0), ("Manchester City", "Man City", 0.9), ("Leeds", "Burnley", 0.0), ("Real Madrid", "Real", 0.0)])
def test_team_tiers(spark, a, b, tier):
    assert values(spark, [(a, b)], "a string, b string", t=text.team_name_tier(F.col("a"), F.col("b"))) == [(tier,)]


@pytest.mark.parametrize("a,b,tier", [("Bukayo Saka", "B. Saka", 0.9), ("Rodri", "Rodrigo Hernández", 0.6), ("Kai Havertz", "Kai Havertz", 1.0), ("Kai Havertz", "K. Rice", 0.0), ("B. Silva", "Bernardo Silva", 0.9)])
def test_player_tiers(spark, a, b, tier):
    assert values(spark, [(a, b)], "a string, b string", t=text.player_name_tier(F.col("a"), F.col("b"))) == [(tier,)]


def test_odds(spark):
    cases = [("4/5", 1.8), ("1/1", 2.0), ("9/10", 1.9), ("6/4", 2.5), ("21/20", 2.05), ("evens", None), ("1/0", None), ("1/2/3", None)]
    got = values(spark, [(a,) for a, _ in cases], "o string", p=odds.fractional_to_decimal(F.col("o")))
    assert [g[0] for g in got] == [w for _, w in cases]
    with pytest.raises(Exception, match="not fractional odds"):
        spark.createDataFrame([("evens",)], "o string").select(odds.require_fraction(F.col("o"))).collect()


def test_market_codes(spark):
    got = values(spark, [("PLAYER_SHOTS_ON@9001@1.5",), ("BTTS",), ("ODD@2.5",)], "c string", m=odds.market_code(F.col("c")))
    assert [tuple(g[0]) for g in got] == [("player_shots_on_target", "9001", 1.5, "PLAYER_SHOTS_ON@9001@1.5"), ("btts", None, None, "BTTS"), ("unknown", None, 2.5, "ODD@2.5")]


def test_price_text(spark):
    got = values(spark, [("2.5",), ("2.500",), ("abc",), (None,)], "p string", t=odds.price_text(F.col("p")))
    assert [g[0] for g in got] == ["2.500", "2.500", "abc", None]


def test_phase_edges(spark):
    edges = {-10081.0: 0, -10080.0: 1, -1440.0: 2, -360.0: 3, -60.0: 4, -5.0: 5, 0.0: 5, 0.1: 6, 45.0: 6, 45.1: 7, 90.0: 7, 120.0: 8, 120.5: 9, None: None}
    from wagerlens.config import PHASES

    got = values(spark, [(m,) for m in edges], "m double", p=clock.phase(F.col("m")))
    assert [g[0] for g in got] == [None if i is None else PHASES[i][0] for i in edges.values()]


def test_clock(spark):
    got = values(spark, [("x-01062025_101500.csv", "31/12/2024 23:59:59"), ("x.csv", "junk")], "f string, t string", v=clock.version_of_file(F.col("f")), t=clock.parse_export_time(F.col("t")))
    assert got[0] == (1748772900000, datetime(2024, 12, 31, 23, 59, 59)) and got[1] == (0, None)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(1, 60), st.floats(0.05, 0.95))
def test_upper_tail_is_a_sum_of_terms(k, n, p):
    wanted = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) if k <= n else 0.0
    assert stats.upper_tails([k], [n], [p])[0] == pytest.approx(min(1.0, wanted), abs=1e-9)


def test_native_tail_and_wilson(spark):
    data = [(k, n) for n in (1, 5, 40) for k in range(0, n + 1, max(1, n // 5))]
    got = values(spark, data, "k long, n long", p=stats.binomial_tail_native(F.col("k"), F.col("n"), F.lit(0.43)), q=stats.binomial_upper_tail("k", "n", F.lit(0.43)), w=stats.wilson_lower(F.col("k"), F.col("n")))
    for (k, n), (p, q, w) in zip(data, got, strict=True):
        assert p == pytest.approx(q, abs=1e-9) and 0 <= w <= k / n + 1e-12
    assert values(spark, [(0, 0)], "k long, n long", w=stats.wilson_lower(F.col("k"), F.col("n"))) == [(0.0,)]


def test_ratio_rounds_half_up(spark):
    assert values(spark, [(1, 20000), (1, 3), (0, 0)], "a long, b long", r=stats.ratio4(F.col("a"), F.col("b"))) == [(0.0001,), (0.3333,), (None,)]
