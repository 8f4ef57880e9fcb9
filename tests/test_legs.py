from datetime import timedelta
from decimal import Decimal

from conftest import rows
from legs_data import SCHEMA, leg, legs_of
from pyspark.sql import functions as F

from wagerlens.operators import breakdown, legs as L, money, timing


def test_betslips_split_collisions_and_keep_combined_stakes_once(spark):
    df = legs_of(spark, [leg("a"), leg("b", selection="2"), leg("c", uid="8", bet_type="COMBINED"), leg("d", uid="8", bet_type="COMBINED", match_id=2)])
    got = {r["row_key"]: r for r in rows(df)}
    assert got["a"]["betslip_id"] != got["b"]["betslip_id"] and got["a"]["had_key_collision"] and got["b"]["leg_count"] == 1
    assert got["c"]["betslip_id"] == got["d"]["betslip_id"] == "8|20250601120000" and got["c"]["leg_count"] == 2 and not got["c"]["had_key_collision"]
    slips = L.betslips(df)
    assert slips.count() == 3 and slips.agg(F.sum("turnover")).first()[0] == Decimal("30.00")
    assert rows(money.inflation(df, slips))[0]["inflation"] == 40 / 30


def test_nulls_in_any_column(spark):
    blank = tuple(None for _ in SCHEMA.split(", "))
    df = legs_of(spark, [blank, leg("a")])
    got = {r["row_key"]: r for r in rows(df)}
    assert got[None]["is_inplay"] is False and got[None]["region"] == "UNKNOWN" and got[None]["base_id"].endswith("NaT")
    assert L.betslips(df).count() == 2
    counts, sums = breakdown.breakdown(df, "competition")
    assert {r["key"] for r in rows(counts)} == {"C", "__null__"} and sum(r["legs"] for r in rows(counts)) == 2
    assert any(r["currency"] is None for r in rows(sums))


def test_empty_tables(spark):
    df = legs_of(spark, [])
    assert L.betslips(df).count() == 0 and L.universe(df).first()["legs"] == 0
    assert breakdown.breakdown(df, "region")[0].count() == 0
    assert timing.phases(df)[0].count() == 10 and timing.daily(L.betslips(df)).count() == 0


def log_rows():
    a = leg("a", ggr="10.00", version=1)
    return [(*a, "placement"), (*leg("a", ggr="10.00", version=5), "reversal"), (*leg("a", ggr="-4.00", version=3), "settlement"), (*leg("b", version=2), "placement"), (*leg("b", version=2), "placement")]


def test_collapse_takes_the_highest_version_in_any_order(spark):
    schema = SCHEMA + ", event_kind string"
    one = rows(L.collapse(spark.createDataFrame(log_rows(), schema)))
    two = rows(L.collapse(spark.createDataFrame(log_rows()[::-1], schema).repartition(3)))
    assert one == two and {r["row_key"]: r["version"] for r in one} == {"a": 5, "b": 2}
    position = L.stream_position(spark.createDataFrame(log_rows(), schema)).first()
    assert (position["position"], position["rows_stored"], position["identities"], position["pending_supersedence"]) == (5, 5, 2, 3)
    prints = {tuple(L.fingerprint(spark.createDataFrame(r, schema)).first()) for r in (log_rows(), log_rows()[::-1], log_rows() * 2)}
    assert len(prints) == 1


def test_uncollapsed_sums_have_the_wrong_sign(spark):
    schema = SCHEMA + ", event_kind string"
    log = spark.createDataFrame([(*leg("a", ggr="-30.00", version=1), "placement"), (*leg("a", ggr="10.00", version=2), "reversal")], schema)
    assert log.agg(F.sum("ggr")).first()[0] < 0 < L.collapse(log).agg(F.sum("ggr")).first()[0]


def test_changed_immutable_facts_are_reported(spark):
    schema = SCHEMA + ", event_kind string"
    log = spark.createDataFrame([(*leg("a", turnover="10.00"), "placement"), (*leg("a", turnover="12.00", currency=None, version=2), "reversal"), (*leg("b"), "placement")], schema)
    assert [(r["row_key"], sorted(r["changed"])) for r in rows(L.immutable_conflicts(log))] == [("a", ["currency", "turnover"])]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x", "f1"), (1, "x", "f1"), (1, "x", "f2"), (2, None, "f2"), (2, None, "f2")], "a int, b string, source_file string")
    assert [(r["source_file"], r["rows_raw"], r["rows_after"], r["removed"]) for r in rows(L.dedup_funnel(df))] == [("f1", 2, 1, 1), ("f2", 3, 2, 1)]
    assert L.cross_source_overlap(df).first()["overlap"] == 1
    assert [(r["a"], r["source_file"]) for r in rows(L.drop_repeats(df))] == [(1, "f1"), (2, "f2")]


def test_breakdown_tail_and_ties(spark):
    df = legs_of(spark, [leg(f"k{i}", minutes=i, unit=u) for i, u in enumerate(["B", "A", "C", "C", "D"])])
    counts, sums = breakdown.breakdown(df, "region", top_n=2)
    assert [(r["key"], r["legs"]) for r in sorted(rows(counts), key=lambda r: r["key"])] == [("A", 1), ("C", 2), ("__other__", 2)]
    assert sum(r["amount"] for r in rows(sums)) == Decimal("50.00")


def test_single_pass_agrees_with_separate_scans(spark):
    df = legs_of(spark, [leg(f"k{i}", minutes=i, unit="ABC"[i % 3], currency=("EUR", "PEN", None)[i % 3]) for i in range(12)])
    got = {(r["key"], r["currency"]): (r["legs"], r["turnover"]) for r in rows(breakdown.single_pass(df)) if r["dimension"] == "region"}
    assert got == {(r["region"], r["currency"]): (r["n_rows"], r["amount"]) for r in rows(money.by_currency(df, "region"))}


def test_money_block(spark):
    df = legs_of(spark, [leg("a"), leg("b", minutes=1, currency=None, turnover="3.00"), leg("c", minutes=2, currency="nan"), leg("d", minutes=3, currency="PEN")])
    block = money.block(df).first()["money"]
    assert block["by_currency"] == {"EUR": Decimal("10.00"), "PEN": Decimal("10.00")} and block["unresolved_rows"] == 2 and block["unresolved_units"] == Decimal("13.00")


def test_daily_operating_flag(spark):
    df = legs_of(spark, [leg(f"k{i}", minutes=i) for i in range(150)] + [leg("late", minutes=60 * 24 * 3)])
    got = {r["betslips"]: r["in_operating_period"] for r in rows(timing.daily(L.betslips(df)))}
    assert got == {150: True, 1: False}


def test_minutes(spark):
    got = {r["row_key"]: (r["minutes_to_kickoff"], r["is_inplay"]) for r in rows(legs_of(spark, [leg("a", lead=30), leg("b", lead=0), leg("c", lead=-1)]))}
    assert got == {"a": (-30.0, False), "b": (0.0, False), "c": (1.0, True)}
    assert timedelta(minutes=1)
