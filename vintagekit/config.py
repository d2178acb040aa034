"""Study configuration: every scope knob and every fixed value in one place.

Values in the FIXED VALUES blocks must equal the source workflows for the
results to agree; they are stated plainly and in their natural order.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# FIXED VALUES - behaviour-score study
# --------------------------------------------------------------------------
VALID_SCORE_MIN = 400
VALID_SCORE_MAX = 900
# status reasons that mark fraud charge-off (52, 88) or deceased (43, 55)
EXCLUSION_REASON_IDS = (52, 88, 43, 55)
EXCLUSION_LOOKBACK_MONTHS = 24
N_DECILES = 10
SCORE_AVAILABILITY_MAX_MOB = 8
ACTIVATION_MAX_MONTHS = 12
BENCHMARK_VANTAGE_MIN = 731
BENCHMARK_BUCKET_MAX = 29
THIN_READ_ELIGIBLE = 200
LIFT_CLEAN = 2.0
LIFT_WEAK = 1.5
# activation x score bands: (label, low inclusive, high inclusive); unscored go to the first
ACTIVATION_SCORE_BANDS = (
    ("<400", None, 399.99),
    ("400-499", 400, 499.99),
    ("500-599", 500, 599.99),
    ("600-699", 600, 699.99),
    ("700-799", 700, 799.99),
    ("800-900", 800, 900),
)
# benchmark credit-line groups: limits and labels, highest first
CREDITLINE_HIGH = 5000
CREDITLINE_MID = 3000
CREDITLINE_GROUPS = ("Group 1 - Credit Line >= $5,000", "Group 2 - $5,000 > Credit Line >= $3,000",
                     "Group 3 - Credit Line < $3,000", "Group Unknown Credit Line")
FUNNEL_BUCKET_MAX = 29


@dataclass(frozen=True)
class Read:
    """One performance read: delinquency bucket reached within a horizon."""

    key: str
    label: str
    bucket: int
    horizon: int


# FIXED VALUES - default reads
DEFAULT_READS = (
    Read("b30_w4", "30+ within 4 cycles", 30, 4),
    Read("b60_w6", "60+ within 6 cycles", 60, 6),
)


@dataclass(frozen=True)
class StudyConfig:
    """Scope of one rank-order study (population, reads, limits)."""

    program_codes: tuple[str, ...] = ("AUTO", "BUIL")
    creditline_tier: float | None = 9000.0
    reads: tuple[Read, ...] = DEFAULT_READS
    valid_min: int = VALID_SCORE_MIN
    valid_max: int = VALID_SCORE_MAX
    exclusion_ids: tuple[int, ...] = EXCLUSION_REASON_IDS
    exclusion_lookback_months: int = EXCLUSION_LOOKBACK_MONTHS
    n_deciles: int = N_DECILES
    perf_start_mob: int = 0
    score_mob: int | None = None
    m1_inclusive: bool = True
    snapshot_month: _dt.date | None = None  # None: the month detected from the data
    benchmark_vantage_min: int = BENCHMARK_VANTAGE_MIN
    benchmark_bucket_max: int = BENCHMARK_BUCKET_MAX
    benchmark_require_blank_status: bool = True
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def codes(self) -> list[str]:
        return [c.strip().upper() for c in self.program_codes if c and c.strip()]

    @property
    def max_horizon(self) -> int:
        return max(r.horizon for r in self.reads)


# --------------------------------------------------------------------------
# FIXED VALUES - campaign pipeline
# --------------------------------------------------------------------------
MAIL_CAMPFLAGS = ("V", "A", "D", "M", "N", "R", "W", "C", "B", "G", "I", "J", "Q")
NEW_MAIL_FLAGS = ("V", "A", "D", "M", "N", "R", "W", "C")
REMAIL_FLAGS = ("B", "G", "I", "J", "Q")
PROSPECTING_FLAGS = ("F", "V", "E")
PQ_ABANDON_FLAGS = ("A", "W")
CHARGEOFF_FLAGS = ("C", "G")
CLOSURE_FLAGS = ("N", "R", "B", "J")
DECLINE_FLAGS = ("D", "M", "Q")
EXPIRED_OFFER_STATUS = "Declined: Expired Offer"
SCORECARD_VANTAGE_CUT = 640
# vantage bands: (label, low, high) inclusive; the last band is open above
VS_BANDS = (
    ("530-549", 530, 549),
    ("550-600", 550, 600),
    ("601-639", 601, 639),
    ("640-700", 640, 700),
    ("701-730", 701, 730),
    ("731-830", 731, None),
)
LOWEST_BAND = "530-549"
FRAUD_DECLINE_STATUSES = (
    "Declined: Identity Verification",
    "Declined: OFAD",
    "Declined: Precise ID KIQ Grading Decision Code Check",
    "Failed Fraud Check SSN Validation",
    "Failed Fraud Match Letter Sent",
    "Failed IP Fraud Score Check",
    "Failed Precise ID Decision Code Check",
    "Failed Precise ID KIQ Grading Decision Code Check",
    "Failed Red Flag - Existing App/Acct Match",
    "PQ Failed IP Fraud Check",
    "PQ Failed IP Velocity",
    "Precise ID Information: Failed to Complete Information Retrieval",
    "Device ID Decline",
    "PQ Device Id Cancel",
    "PQ Device Id Decline",
    "2nd device ID Decline",
    "Precise ID Device Evaluation Information: Failed to Complete Information Retrieval",
    "Failed Precise ID Device Evaluation Decision Code Check",
    "Failed Precise ID Device Evaluation KIQ Grading Decision Code Check",
    "Skip PQ Device Id Cancel",
    "Skip Prequal Failed IP Fraud Score Check",
    "Skip PQ Failed IP Velocity",
    "Declined: Potential Identity Theft",
    "CrossCore Failed Fraud Shield 5",
    "CrossCore Failed Fraud Shield 13",
    "CrossCore Failed Fraud Shield 14",
    "CrossCore Failed Fraud Shield 25",
    "CrossCore Failed Exception Score 9001",
    "CrossCore Failed Exception Score 9013",
    "CrossCore Mitek Id Authentication Failed",
    "Fail CIP Checks Crosscore Solicited",
    "Fail PreciseID Checks Crossscore",
    "Sentilink Check Failed",
    "Failed Negative List Check",
    "Declined: Failed Hotfile Check",
    "Crosscore Verification Failed",
)

# Fixed response-score cut points, decile 1 first: (low, high) closed intervals.
# "total" applies to every row; sc1..sc4 are per-scorecard sets.
FIXED_CUTS = {
    "total": (
        (0.02908089, 1), (0.0178773, 0.02908088), (0.01394068, 0.01787729),
        (0.01147906, 0.01394067), (0.00966261, 0.01147905), (0.00832388, 0.0096626),
        (0.00726601, 0.00832387), (0.00636179, 0.007266), (0.00522037, 0.00636178),
        (0, 0.00522036),
    ),
    "sc1": (
        (0.02656043, 1), (0.01589291, 0.02656042), (0.0123958, 0.0158929),
        (0.01030504, 0.01239579), (0.0087901, 0.01030503), (0.00778552, 0.00879009),
        (0.00706834, 0.00778551), (0.00651691, 0.00706833), (0.00606842, 0.0065169),
        (0, 0.00606841),
    ),
    "sc2": (
        (0.01668371, 1), (0.01153198, 0.0166837), (0.00931244, 0.01153197),
        (0.00798018, 0.00931243), (0.00703765, 0.00798017), (0.00635339, 0.00703764),
        (0.00569877, 0.00635338), (0.00513585, 0.00569876), (0.00421288, 0.00513584),
        (0, 0.00421287),
    ),
    "sc3": (
        (0.0536694, 1), (0.02849683, 0.05366939), (0.02063868, 0.02849682),
        (0.01707402, 0.02063867), (0.01475292, 0.01707401), (0.01279835, 0.01475291),
        (0.01113234, 0.01279834), (0.00960001, 0.01113233), (0.00805475, 0.0096),
        (0, 0.00805474),
    ),
    "sc4": (
        (0.02486282, 1), (0.01759291, 0.02486281), (0.01432997, 0.0175929),
        (0.01228554, 0.01432996), (0.01070027, 0.01228553), (0.00958126, 0.01070026),
        (0.00867152, 0.00958125), (0.00785271, 0.00867151), (0.00629435, 0.0078527),
        (0, 0.00629434),
    ),
}

# Rollup grouping dimensions, in output order.
ROLLUP_DIMENSIONS = (
    "Prospect_type",
    "pqabandon_flag",
    "prchargeoff_flag",
    "prclosure_flag",
    "prdecline_flag",
    "vs_band",
    "annual_fee",
    "times_mailed_12mo_cnt",
    "trm10_tier",
    "scorecard",
    "rm_flag",
)

# --------------------------------------------------------------------------
# FIXED VALUES - response mart
# --------------------------------------------------------------------------
REQUIRED_ROLLUP_COLUMNS = ROLLUP_DIMENSIONS[:10] + ("rm_flag", "volume", "responders", "expected_responses", "Boards")
OPTIONAL_ROLLUP_COLUMNS = {"expected_responses_xpm": None}
DROP_RATE_COLUMNS = ("GRR", "NRR")
FLAG_COLUMNS = ("pqabandon_flag", "prchargeoff_flag", "prclosure_flag", "prdecline_flag", "rm_flag", "scorecard", "trm10_tier")
ROLLUP_COLUMNS = REQUIRED_ROLLUP_COLUMNS + tuple(OPTIONAL_ROLLUP_COLUMNS) + DROP_RATE_COLUMNS
RECENT_REFRESH_WINDOW_MONTHS = 3
HISTORY_FREEZE_MONTHS = 24
SMALL_CELL_THRESHOLD = 100
DEFAULT_LOOKBACK_MONTHS = 24
DEFAULT_ROW_DIM = "vs_band"
DEFAULT_METRIC = "actual_board_rate"
KPI_GOOD = 0.95
KPI_BAD = 0.80
MOM_ALPHA_BASE = 0.18
MOM_ALPHA_SPAN = 0.52
VOLUME_SHARE_MIN = 2
VOLUME_SHARE_MAX = 100
MONTH_ABBREVIATIONS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
TWO_DIGIT_YEAR_PIVOT = 80

METRIC_COLUMNS = (
    "volume",
    "responders",
    "Boards",
    "actual_board_rate",
    "actual_response_rate",
    "expected_rr_trm",
    "expected_rr_xpm",
    "actual_vs_expected_trm",
    "actual_vs_expected_xpm",
)
COUNT_METRICS = ("volume", "responders", "Boards")
RATIO_METRICS = ("actual_vs_expected_trm", "actual_vs_expected_xpm")
RATE_COLUMNS = (
    "actual_response_rate",
    "actual_board_rate",
    "expected_rr_trm",
    "expected_rr_xpm",
    "actual_vs_expected_trm",
    "actual_vs_expected_xpm",
)
