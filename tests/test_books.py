"""Books that leave reports without a divisor, and books with more rows than a report shows."""

import pytest
from conftest import rows
from legs_data import SCHEMA, leg
from wagerlens.operators import legs as L, quality, sharp
from wagerlens.operators.prices import attach_value
from wagerlens.plans import artifacts as A, payload as P
from wagerlens.streaming import refresh

#: A first day's books: nothing, no prices, no known currency, free bets only, dates unknown.
BOOKS = {
    "empty": [],
    "unpriced": [leg("a", price=None), leg("b", price="1.000", uid="8")],
    "no currency": [leg("a", currency=None), leg("b", currency="nan", uid="8")],
    "free bets": [leg("a", turnover="0.00", ggr="0.00"), leg("b", turnover="0.00", uid="8", bet_type="COMBINED")],
    "no dates": [(*leg("a")[:1], None, None, *leg("a")[3:])],
}


def log_of(spark, data):
    return spark.createDataFrame([(*r, "placement") for r in data], SCHEMA + ", event_kind string")


@pytest.mark.parametrize("name", sorted(BOOKS))
def test_reports_of_a_book_without_divisors(spark, name):
    log = log_of(spark, BOOKS[name])
    legs = L.enrich(log)
    assert quality.shape(log).count() == 1 and quality.data_quality(legs).first()["legs"] == len(BOOKS[name])
    assert quality.book_summary(legs, L.betslips(legs)).filter("margin IS NOT NULL").count() == (name in ("unpriced", "no dates"))
    assert sharp.score(attach_value(legs)).filter("flagged").count() == 0


def test_all_classes_of_an_empty_book(spark):
    made = refresh.refresh(log_of(spark, []))
    assert A.check_invariants(made) == [] and len(made) == 8


def test_margin_is_null_without_turnover(spark):
    legs = L.enrich(spark.createDataFrame(BOOKS["free bets"], SCHEMA))
    (book,) = rows(quality.book_summary(legs, L.betslips(legs)))
    assert book["margin"] is None and book["mean_stake"] == 0.0
    assert quality.shape(log_of(spark, [])).first()["simple_share"] is None and quality.shape(log_of(spark, BOOKS["no currency"])).first()["eur_share"] == 0.0
    assert quality.data_quality(L.enrich(spark.createDataFrame([], SCHEMA))).first()["inplay_share"] is None


def many_currencies(spark, n=60):
    """A currency for each of n, 110 betslips each, and a Uid that beats the last price on 40 fixtures."""
    money = [leg(f"m{i}", uid=f"u{i % 700}", minutes=i, match_id=i % 30, currency=f"C{i % n:02d}", selection=str(i), price="2.000") for i in range(110 * n)]
    beats = []
    for m in range(40):
        beats += [leg(f"s{m}", uid="S", minutes=m, match_id=500 + m, price="2.200"), leg(f"n{m}", uid=f"N{m % 2}", minutes=m + 1, match_id=500 + m, price="1.900"), leg(f"c{m}", uid="C", minutes=m + 100, match_id=500 + m, price="2.000")]
    return spark.createDataFrame(money + beats, SCHEMA).repartition(4)


def test_long_reports_are_cut_with_an_account_and_findings_still_resolve(spark, monkeypatch, tmp_path):
    raw = many_currencies(spark)
    data = refresh._concentration(L.enrich(raw).cache())
    account = data["truncation"]["lorenz"]
    assert account["total"] > A.LONGEST == account["shipped"] == len(data["lorenz"]) and account["omitted"] == account["total"] - A.LONGEST
    monkeypatch.setattr(P, "LONGEST", 1)  # of three windows that may be flagged one is listed
    built = P.build(raw)
    try:
        assert P.check(built.payload) == []
        assert [r["uid"] for r in built.payload["sharp"]["flagged_windows"]["rows"]] == ["S"]
        assert built.payload["sharp"]["eligible_windows"]["truncation"]["omitted"] == 2
        assert [r["uid"] for r in P.resolve(built.payload, built.payload["sharp"]["flagged_windows"]["rows"][0]["verify_ref"])] == ["S"]
        P.write(built, tmp_path)
        assert spark.read.option("header", True).csv(str(tmp_path / "tables" / "lorenz")).count() == account["total"]
    finally:
        built.release()
