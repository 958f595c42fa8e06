"""A cross-section of the registered queries against DuckDB; ``python -m checks.compare`` runs all."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLE
from conftest import SMALL
from vigilframe.catalog import QUERIES

CHOSEN = [
    "scan_attempt_batches",
    "scan_score_log",
    "normalize_events",
    "rejected_events",
    "asof_prev_event",
    "asof_next_event",
    "paste_attribution",
    "report_identity_fallback",
    "attempt_features_ext",
    "ml_features_refine",
    "score_attempts",
    "score_attempts_extended",
    "hybrid_decision",
    "detect_patterns",
    "classification_report",
    "review_queue",
    "evidence_items",
    "latest_per_attempt",
    "progressive_risk_ttl",
    "progressive_risk_late",
    "refine_low_medium",
    "format_duration",
    "typing_sessions",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLE[name]) is None
