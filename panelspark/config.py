"""Protocol constants. Everything below is a fixed value of the evaluation protocol."""

from __future__ import annotations

from dataclasses import dataclass, field

# Target definition.
EPOCH = "1975-01-01"
DAYS_PER_YEAR = 365.25
BIG_JUMP_YEARS = 8

# Evaluation protocol.
SEASON = 12
HOLDOUT = 24
BUFFER = 6
MIN_TRAIN = {"FAD": 60, "DFF": 36}
MIN_F_EVALUABLE = 84
HORIZONS = (1, 3, 6, 12, 24, 36, 48, 60)
MAX_INTERPOLABLE_GAP = 3
VAL_TUNE = 24
VAL_CONFIRM = 12

# Intervals and bands.
ALPHA = 0.05
BAND80_RATIO = 0.4744
MIN_CELL_N = 30
SMALL_N = 30
ACI_GAMMAS = (0.01, 0.03, 0.05, 0.1)
ACI_MIN_HITS = 8
QUANTILE_LEVELS = (0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975)

# Drift and promotion policy.
PERF_RATIO = 1.5
COV95_FLOOR = 0.85
COVERAGE_MIN_N = 30
DATA_K = 8.0
DATA_MIN_FLAGGED = 8
RECAMPAIGN_STREAK = 3
MATERIAL_MARGIN = 0.005
POLICY = {
    "modes_allowed": ["live"],
    "horizon_bands": {"h1_3": (1, 3), "h4_6": (4, 6), "h7_12": (7, 12)},
    "min_pairs_per_band": 30,
    "min_live_vintages": 3,
    "material_margin": 0.10,
    "max_band_regression": 0.05,
    "min_cov95": 0.90,
    "max_cov95_gap": 0.03,
    "alpha_holm": 0.05,
    "min_series_for_test": 5,
}

# Regime order used when several cells claim the same key.
REGIME_RANK = {"F": 0, "C": 1, "U": 2, "UNK": 3}
REGIMES = ("F", "C", "U", "UNK")

# Column groups.
SERIES = ["country", "block", "category", "table"]
PANEL_KEY = [*SERIES, "bulletin_date"]
PANEL_COLS = [*PANEL_KEY, "status", "priority_date", "days_since_base", "raw_value"]
LEDGER_KEY = ["origin", "country", "category", "table", "date"]
LEDGER_PAYLOAD = ["h", "days", "lo80", "hi80", "lo95", "hi95"]
WORLD = "all_chargeability"


@dataclass(frozen=True)
class Protocol:
    """Walk-forward protocol; the defaults are the published ones, short panels pass their own."""

    season: int = SEASON
    holdout: int = HOLDOUT
    buffer: int = BUFFER
    min_train: dict = field(default_factory=lambda: dict(MIN_TRAIN))
    min_f: int = MIN_F_EVALUABLE
    val_tune: int = VAL_TUNE
    val_confirm: int = VAL_CONFIRM
