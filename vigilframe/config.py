"""Parameters of the operators. All of them become literals in the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

LABELS = ("LOW", "MEDIUM", "HIGH")

# Signal names in reporting order with their weights.
SIGNAL_WEIGHTS = {
    "timing": 0.21,
    "tab": 0.16,
    "clipboard": 0.21,
    "idle": 0.12,
    "answer_changes": 0.20,
    "typing": 0.10,
}

# Fixed values: (low, high) bounds of the documented ramps; high < low means inverted.
RAMP_BOUNDS = {
    "fast_ratio": (0.10, 0.35),
    "p10_time_s": (9.0, 4.0),
    "cv": (0.60, 1.20),
    "tab_hidden_ratio": (0.08, 0.25),
    "tab_hidden_per_min": (0.25, 1.20),
    "paste_per_q": (0.05, 0.35),
    "paste_q_affected": (1.0, 5.0),
    "kps": (2.2, 0.8),
    "typing_bursts_per_min": (0.5, 0.1),
    "idle_ratio": (0.10, 0.28),
    "idle_spike_count": (1.0, 4.0),
    "changes_per_q": (0.45, 1.20),
    "last_min_changes": (2.0, 8.0),
}


@dataclass(frozen=True)
class HotKeys:
    """How many rows of one attempt a single task may order, and what may be broadcast.

    An attempt above ``hot_rows`` is cut into range slices of about ``slice_rows`` rows.
    ``hot_rows=None`` skips the size check (attempts are known to be small).
    """

    hot_rows: int | None = 1_000_000
    slice_rows: int = 1_000_000
    broadcast_rows: int = 200_000


@dataclass(frozen=True)
class ScoringRules:
    # signals
    fast_mean_s: float = 8.0
    no_timing_s: float = 100.0
    tab_full: int = 3
    paste_full: int = 2
    idle_floor: float = 0.1
    weights: dict = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
    # combination
    support: float = 0.20
    elevated: float = 0.60
    strong: float = 0.85
    require_elevated: int = 2
    bonus_weight: float = 0.20
    weak_cap: float = 0.66
    none_cap: float = 0.45
    strong_bonus: float = 0.05
    # decision
    high_score: float = 0.80
    medium_score: float = 0.45
    promote_strength: float = 0.6
    ml_medium_confidence: float = 0.60
    ml_high_confidence: float = 0.85
    # rule confidence
    full_questions: int = 20
    full_duration_s: float = 1200.0
    seq_gap_penalty: float = 0.08
    no_submit_penalty: float = 0.35
    # evidence confidence
    w_count: float = 0.35
    w_strength: float = 0.45
    w_patterns: float = 0.20
    ml_share: float = 0.30


@dataclass(frozen=True)
class PatternRules:
    tab_to_paste_s: float = 30.0
    idle_to_tab_s: float = 45.0
    paste_to_leave_s: float = 30.0
    require_paste: int = 2
    require_hidden: int = 1
    medium_tab_min: int = 3
    medium_tab_max: int = 6
    medium_low_avg_s: float = 80.0
    medium_min_ratio: float = 0.04
    medium_min_questions: int = 10
    idle_to_leave_s: float = 35.0
    idle_fast_min_hidden: int = 3
    idle_fast_min_ratio: float = 0.01
    fast_answer_s: float = 10.0
