"""What the rows of a report must satisfy, for the batch payload and the refreshed artifacts alike; failures as text.

Rows are as a report has them: shares with 4 decimals, so that equal shares differ by half a ten-thousandth at most.
"""

from __future__ import annotations

from ..config import DEFAULTS

ROUNDED = 1e-4


def _rate(found: float | None, hits: int, of: int) -> bool:
    """Whether a reported rate is hits / of; no rate where there is nothing to count."""
    return found is None if not of else found is not None and abs(found - hits / of) <= ROUNDED


def of_prices(report: dict) -> list[str]:
    """Eligible legs and groups make all pre-match legs, references all eligible legs, and beats the rate."""
    out = []
    if report["eligible_legs"] + report["groups_total"] != report["pre_match_legs"]:
        out.append("prices: eligible legs and groups are not all pre-match legs")
    if report["reference_from_other_uid"] + report["reference_from_same_uid"] != report["eligible_legs"]:
        out.append("prices: references don't add up to eligible legs")
    if not _rate(report["population_beat_rate"], report["beats"], report["eligible_legs"]):
        out.append("prices: the beat rate is not beats by eligible legs")
    return out


def of_sharp(report: dict, prices: dict | None, flagged: list[dict], account: dict | None = None) -> list[str]:
    """Flagged, eligible and scored windows are a chain; their units come from priced legs; each flagged row passes the gate itself."""
    out = []
    if not report["flagged_windows"] <= report["flag_eligible_windows"] <= report["scored_windows"]:
        out.append("sharp: flagged, eligible and scored windows are no chain")
    legs = report["legs_in_scope"] or 0
    if report["scoring_units_total"] > legs or prices and legs != prices["reference_from_other_uid"]:
        out.append("sharp: units or their legs are not those that have another Uid's reference")
    baseline = report["baseline_beat_rate"]
    if (baseline is None) != (report["scoring_units_total"] == 0) or baseline is not None and not 0 <= baseline <= 1:
        out.append("sharp: the baseline is no rate of the units")
    total = account["total"] if account else len(flagged)
    if total != report["flagged_windows"]:
        out.append(f"sharp: {total} flagged windows listed, {report['flagged_windows']} counted")
    for row in flagged:
        gate = {
            "units": row["priced_units"] >= DEFAULTS.flag_units,
            "p-value": bool(row["fdr_pass"]) and row["p_value"] is not None and row["p_value"] <= DEFAULTS.fdr_q + ROUNDED,
            "stake-weighted value": (row["stake_weighted_price_value"] or 0) >= 0 and row["stake_weighted_price_value"] is not None,
            "beat rate": _rate(row["beat_rate"], row["beats"], row["priced_units"]) and (baseline is None or row["beat_rate"] >= baseline - ROUNDED),
        }
        out += [f"sharp: {row['uid']} is flagged against its {what}" for what, passed in gate.items() if not passed]
    return out
