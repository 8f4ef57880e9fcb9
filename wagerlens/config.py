"""Operating constants.  Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass


#: Fixed values throughout: thresholds that results must agree with.
@dataclass(frozen=True)
class Settings:
    top_n: int = 15
    selection_markets: int = 5
    winsor_micro: int = 500_000  # price value is clipped to +-0.5
    movement_group: int = 5
    sharp_move: float = 0.25
    sharp_move_uids: int = 2
    spike_multiplier: int = 5
    operating_share: float = 0.01
    spike_days: int = 10
    repeat_betslips: int = 3
    exposure_quantile: float = 0.90
    exposure_share: float = 0.50
    exposure_fixture_legs: int = 50
    exposure_fixtures: int = 10
    exposure_selection_legs: int = 20
    score_betslips: int = 10
    flag_units: int = 20
    wilson_z: float = 1.96
    fdr_q: float = 0.10
    late_minutes: int = 60
    lorenz_points: int = 101
    gini_betslips: int = 100
    gini_fixtures: int = 20
    table_rows: int = 50
    movers: int = 25


DEFAULTS = Settings()

#: Time phases by minutes from kick-off, (label, low, high), None for no bound.  A phase before
#: kick-off holds low <= m < high, except that the last of them also holds 0; a later one low < m <= high.
PHASES = (
    ("More than 7d before", None, -10080),
    ("7d to 24h before", -10080, -1440),
    ("24h to 6h before", -1440, -360),
    ("6h to 60m before", -360, -60),
    ("60m to 5m before (post-lineups proxy)", -60, -5),
    ("5m to kick-off", -5, 0),
    ("In-play: 0-45m", 0, 45),
    ("In-play: 45-90m", 45, 90),
    ("In-play: 90-120m (extra time)", 90, 120),
    ("More than 120m after kick-off (residual)", 120, None),
)

#: Whole market names that are combination bets of one side.
BUILDER_MARKETS = {
    "{COMPETITOR1}": "Home-side combo (bet builder)",
    "{COMPETITOR2}": "Away-side combo (bet builder)",
}

#: Display names of the outcomes of a 1X2 market.
OUTCOME_NAMES = {"1": "Home win (1)", "2": "Away win (2)", "X": "Draw (X)"}

#: Refresh classes: seconds between runs and the artifacts that each owns.
REFRESH_CLASSES = {
    1: (5, ("overview", "flow", "timing")),
    2: (60, ("prices", "data_quality")),
    3: (300, ("concentration", "anomalies", "sharp")),
}
