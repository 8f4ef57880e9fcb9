"""Each invariant of prices and flagged windows fails when, and only when, its numbers are broken."""

import pytest

from wagerlens.plans import invariants as I

PRICES = {"eligible_legs": 30, "groups_total": 10, "pre_match_legs": 40, "reference_from_other_uid": 25, "reference_from_same_uid": 5, "population_beat_rate": 0.3333, "beats": 10}
REPORT = {"flagged_windows": 1, "flag_eligible_windows": 2, "scored_windows": 3, "legs_in_scope": 25, "scoring_units_total": 24, "baseline_beat_rate": 0.3333}
ROW = {"uid": "S", "priced_units": 20, "beats": 19, "beat_rate": 0.95, "fdr_pass": True, "p_value": 0.0, "stake_weighted_price_value": 0.0}


def failures(prices=PRICES, report=REPORT, row=ROW, account=None):
    return I.of_prices(prices) + I.of_sharp(report, prices, [row], account)


def test_whole_numbers_pass():
    assert failures() == [] and failures(account={"total": 1}) == []
    empty = dict.fromkeys(PRICES, 0) | {"population_beat_rate": None}
    none = dict.fromkeys(REPORT, 0) | {"legs_in_scope": None, "baseline_beat_rate": None}
    assert I.of_prices(empty) == [] and I.of_sharp(none, empty, []) == []


@pytest.mark.parametrize(
    ("part", "change", "said"),
    [
        ("prices", {"groups_total": 9}, "eligible legs and groups"), ("prices", {"reference_from_same_uid": 4}, "references"), ("prices", {"population_beat_rate": 0.34}, "beat rate"),
        ("prices", {"population_beat_rate": None}, "beat rate"), ("report", {"flag_eligible_windows": 0}, "chain"), ("report", {"legs_in_scope": 24}, "reference"), ("report", {"scoring_units_total": 26}, "reference"),
        ("report", {"baseline_beat_rate": None}, "baseline"), ("report", {"flagged_windows": 2}, "1 flagged windows listed, 2"), ("account", {"total": 7}, "7 flagged windows listed"),
        ("row", {"priced_units": 19, "beats": 19, "beat_rate": 1.0}, "units"), ("row", {"fdr_pass": False}, "p-value"), ("row", {"p_value": 0.2}, "p-value"), ("row", {"p_value": None}, "p-value"),
        ("row", {"stake_weighted_price_value": -0.1}, "value"), ("row", {"stake_weighted_price_value": None}, "value"), ("row", {"beat_rate": 0.9}, "beat rate"), ("row", {"beats": 5, "beat_rate": 0.25}, "beat rate"),
    ],
)
def test_a_broken_number_is_told(part, change, said):
    base = {"prices": PRICES, "report": REPORT, "row": ROW, "account": {"total": 1}}
    (told,) = failures(**{part: base[part] | change})
    assert said in told
