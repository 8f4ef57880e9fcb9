from decimal import Decimal

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from legs_data import leg, legs_of
from pyspark.sql import functions as F

from wagerlens.operators import anomalies, concentration, legs as L, players, prices, sharp


def test_price_reference_is_the_last_of_the_group(spark):
    df = legs_of(spark, [leg("a", minutes=0, price="3.000"), leg("b", minutes=5, price="2.500", uid="8"), leg("c", minutes=9, price="2.000", uid="7"), leg("in", minutes=0, lead=-5, price="9.000"), leg("one", minutes=0, price="1.000"), leg("alone", selection="X")])
    got = {r["row_key"]: r for r in rows(prices.attach_value(df))}
    assert got["a"]["value_micro"] == 500_000 and got["a"]["reference_is_own_bet"] and got["b"]["value_micro"] == 250_000 and not got["b"]["reference_is_own_bet"]
    assert not any(got[k]["value_eligible"] for k in ("c", "in", "one", "alone")) and got["c"]["group_leg_count"] == 3 and got["in"]["group_leg_count"] == 0
    c = prices.coverage(prices.attach_value(df)).first()
    assert c["eligible_legs"] == c["pre_match_legs"] - c["groups_total"] == 2


def test_strict_ties_have_no_reference(spark):
    df = legs_of(spark, [leg("a", price="3.000"), leg("b", uid="8", price="2.000")])
    assert prices.attach_value(df).filter("value_eligible").count() == 1
    assert prices.attach_value(df, strict_ties=True).filter("value_eligible").count() == 0


def test_value_is_winsorised(spark):
    df = legs_of(spark, [leg("a", price="9.000"), leg("b", minutes=3, uid="8", price="2.000")])
    r = [r for r in rows(prices.attach_value(df)) if r["row_key"] == "a"][0]
    assert r["value_micro"] == 3_500_000 and r["value_winsorised"] == 500_000


def test_movement_masks_mixed_currencies(spark):
    df = legs_of(spark, [leg(f"k{i}", minutes=i, uid=str(i), price=p, currency=("EUR", "PEN")[i == 4]) for i, p in enumerate(["4.000", "3.000", "3.000", "2.500", "2.000"])] + [leg(f"f{i}", minutes=i, selection="2") for i in range(5)] + [leg("thin", selection="X")])
    got = {r["selection"]: r for r in rows(prices.movement(df))}
    assert set(got) == {"1", "2"} and got["1"]["turnover"] is None and got["1"]["implied_prob_move"] == 1.0 and got["1"]["is_sharp_move"]
    assert got["2"]["direction"] == "drifter" and got["2"]["turnover"] == Decimal("50.00") and not got["2"]["is_sharp_move"]


def gini_of(values):
    v = np.sort(np.array(values, dtype=float))
    n = len(v)
    return 2 * np.sum(np.arange(1, n + 1) * v) / (n * v.sum()) - (n + 1) / n


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50_000), min_size=2, max_size=60).filter(lambda v: sum(v) > 0))
def test_concentration_equals_numpy(spark, values):
    df = spark.createDataFrame([("p", Decimal(v) / 100) for v in values], "population string, value decimal(28,2)")
    g = concentration.gini(df).first()
    assert g["n_units"] == len(values) and g["gini"] == pytest.approx(gini_of(values), abs=6e-5) and 0 <= g["gini"] <= 1
    v = np.sort(np.array(values) / 100)
    n, c = len(v), np.concatenate([[0], np.cumsum(v) / v.sum()])
    curve = {r["point"]: r["share"] for r in rows(concentration.lorenz(df))}
    wanted = np.interp(np.linspace(0, 1, 101), np.arange(n + 1) / n, c)
    assert len(curve) == 101 and all(abs(curve[i] - wanted[i]) < 2e-6 for i in range(101))
    shares = {r["cut"]: r["share"] for r in rows(concentration.top_shares(df))}
    assert shares["top_10_units"] == pytest.approx(v[::-1][:10].sum() / v.sum(), abs=6e-5)


def test_concentration_leaves_out_small_and_zero_populations(spark):
    df = spark.createDataFrame([("one", Decimal(5)), ("zero", Decimal(0)), ("zero", Decimal(0)), ("bad", None), ("bad", Decimal(-1))], "population string, value decimal(28,2)")
    assert concentration.gini(df).count() == 0 and concentration.lorenz(df).count() == 0


def test_repeat_backing_counts_a_stake_once(spark):
    df = legs_of(spark, [leg(f"k{i}", minutes=i, turnover="5.00") for i in range(3)] + [leg("x1", minutes=9, bet_type="COMBINED", turnover="7.00"), leg("x2", minutes=9, bet_type="COMBINED", turnover="7.00", match_id=2)] + [leg("n", player=None)])
    (r,) = rows(anomalies.repeat_backing(prices.attach_value(df)))
    assert r["betslips"] == 4 and r["stake"] == 22.0 and r["span_minutes"] == 9.0 and r["currency"] == "EUR"


def test_same_second_clusters(spark):
    df = legs_of(spark, [leg("a"), leg("b", match_id=2, currency="PEN"), leg("c", uid="9")])
    (r,) = rows(anomalies.same_second_clusters(df))
    assert r["cluster_size"] == 2 and r["fixtures"] == 2 and r["stake"] is None and r["currency"] is None


def test_exposure(spark):
    data = [leg(f"m{m}k{i}", uid=str(i), minutes=i, match_id=m, selection=("1", "2")[i % 2], turnover="10.00") for m in range(9) for i in range(4)]
    data += [leg(f"big{i}", uid=str(i), minutes=i, match_id=99, selection=("1", "1", "1", "2")[i % 4], turnover="100.00") for i in range(8)]
    got = rows(anomalies.abnormal_exposure(legs_of(spark, data), fixture_legs=4, fixtures=10, selection_legs=5, share=0.6))
    assert [(r["match_id"], r["share"], r["legs"], r["single_actor"]) for r in got] == [(99, 0.75, 6, False)]


def test_spikes(spark):
    data = [leg(f"d{d}k{i}", minutes=d * 1440 + i, turnover=f"{10 + d % 3}.00") for d in range(12) for i in range(3)] + [leg("s", minutes=11 * 1440 + 50, turnover="900.00")]
    (r,) = rows(anomalies.turnover_spikes(L.betslips(legs_of(spark, data))))
    assert r["excess_ratio"] > 1 and r["mad"] > 0 and r["betslips"] == 4


def test_bh_equals_the_definition(spark):
    rng = np.random.default_rng(3)
    for q in (0.05, 0.2, 0.6):
        p = np.round(np.concatenate([rng.random(40), rng.random(20) * 0.02, [0.01, 0.01]]), 6)
        order = np.sort(p)
        ok = order <= q * np.arange(1, len(p) + 1) / len(p)
        limit = order[ok].max() if ok.any() else -1
        df = sharp.benjamini_hochberg(spark.createDataFrame([(float(x),) for x in p] + [(None,)], "p double"), "p", q)
        assert all(r["fdr_pass"] == (r["p"] is not None and r["p"] <= limit) for r in rows(df))


def test_percentile_rank_averages_ties(spark):
    df = sharp.percentile_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double"), "v", "s")
    assert [r["s"] for r in rows(df)] == [25.0, 62.5, 62.5, 100.0]


def test_sharp_flags_a_uid_that_beats_the_line(spark):
    data = []
    for m in range(60):
        sharp_price = "2.200" if m < 50 else "2.000"
        data += [leg(f"s{m}", uid="S", minutes=m, match_id=m, price=sharp_price), leg(f"n{m}", uid=f"N{m % 4}", minutes=m + 1, match_id=m, price="1.900"), leg(f"c{m}", uid="C", minutes=m + 100, match_id=m, price="2.000")]
    priced = prices.attach_value(legs_of(spark, data))
    got = {r["uid"]: r for r in rows(sharp.score(priced))}
    assert got["S"]["flagged"] and got["S"]["priced_units"] == 60 and got["S"]["score"] == 100.0 and not any(got[u]["flagged"] for u in got if u != "S")
    report = sharp.report(priced, sharp.score(priced)).first()
    assert report["flagged_windows"] == 1 and report["flags_under_top_decile"] == 0


def test_players(spark):
    data = [
        leg("a", market="Shots {PLAYER}", player="Remates Arda Guler"), leg("b", market="Shots {PLAYER}", player="Remates Kylian Mbappe (Star Substitute)", minutes=1),
        leg("c", market="Anytime goalscorer", selection="Harry Kane", minutes=2), leg("d", market="Anytime goalscorer", selection="no goal", minutes=3),
        leg("e", market="Team to score", selection="Home", minutes=4), leg("f", market="1X2", minutes=5),
    ]
    got = {r["row_key"]: (r["player_family"], r["player_name"]) for r in rows(players.resolve(legs_of(spark, data)))}
    assert got == {"a": ("template_player", "Arda Guler"), "b": ("template_player", "Kylian Mbappe"), "c": ("name_in_option", "Harry Kane"), "d": ("name_in_option", None), "e": ("not_player_centric", None), "f": ("not_player_centric", None)}


def test_alerts(spark):
    df = prices.attach_value(legs_of(spark, [leg("a"), leg("b", match_id=2)]))
    found = anomalies.alerts(sharp.score(df).filter("flagged"), anomalies.abnormal_exposure(df), anomalies.turnover_spikes(L.betslips(df)), anomalies.same_second_clusters(df), anomalies.repeat_backing(df))
    assert rows(anomalies.severity_counts(found)) == [{"section": "clusters", "severity": "signature", "alerts": 1}]
    assert df.select(F.lit(1)).count() == 2
