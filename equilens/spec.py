"""Audit specification and the default thresholds of the audit."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Defaults of the audit (must match for equal results)
# ---------------------------------------------------------------------------
TEST_SIZE = 0.20
THRESHOLD = 0.5
DPD_LIMIT = 0.10
DIR_LO, DIR_HI = 0.80, 1.25
EOD_LIMIT = 0.10
P_LIMIT = 0.05
SMOTE_K = 5
COUNTERFACTUAL_N = 1000     # base rows of the copies that an audit's models are fitted on; the operator and the ablation take all
LIME_SAMPLES = 200
DISPARITY_LIMIT = 0.20
DISPARITY_FLOOR = 1e-6
COPULA_CLIP = 1e-6
CORR_UNKNOWN_SHIFT = 1e-6
CORR_MIN_EIGENVALUE = 1e-6
CORR_JITTER = 1e-8
SEEDS = tuple(range(42, 52))
MISSING_CATEGORY = "missing"


@dataclass(frozen=True)
class Thresholds:
    dpd: float = DPD_LIMIT
    dir_lo: float = DIR_LO
    dir_hi: float = DIR_HI
    eod: float = EOD_LIMIT
    p: float = P_LIMIT


@dataclass
class AuditSpec:
    """What to audit: the table's label, sensitive columns and features.

    ``features`` empty means "every column except label and id" (the
    sensitive columns stay features). ``categorical`` lists columns treated
    as categories even when numeric; string columns are always categorical.
    """

    name: str
    label: str
    sensitive: list[str]
    id_col: str = "row_id"
    features: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    null_tokens: list[str] = field(default_factory=list)
    thresholds: Thresholds = field(default_factory=Thresholds)
