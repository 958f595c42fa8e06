"""Schemas at the edges. Payloads arrive as JSON text and are lifted once, by ``normalize``."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PAYLOAD = _struct(
    action=_S,
    state=_S,
    question_id=_S,
    size=_S,
    source=_S,
    reason=_S,
    duration_seconds=_D,
    keystrokes=_L,
    answer=_S,
    answer_length=_L,
    change_type=_S,
    paste_recent_ms=_L,
    paste_size=_S,
)

# payload and client_seq stay text here: a nested object read as string keeps unknown keys
BATCH_EVENT = _struct(event_type=_S, occurred_at=_S, payload=_S, attempt_id=_S, client_seq=_S)

ATTEMPT_BATCH = _struct(attempt_id=_S, events=T.ArrayType(BATCH_EVENT))

IDENTITY = ("candidate_id", "candidate_name", "candidate_email", "assessment_id", "assessment_name")

INGEST_EVENT = _struct(
    attempt_id=_S,
    candidate_id=_S,
    candidate_name=_S,
    candidate_email=_S,
    assessment_id=_S,
    assessment_name=_S,
    event_type=_S,
    payload=_S,
    occurred_at=_S,
)

RAW_EVENT_COLUMNS = (
    "id",
    "attempt_id",
    *IDENTITY,
    "event_type",
    "payload",
    "occurred_at",
    "received_at",
)

FEATURES = _struct(
    paste_count=_L,
    tab_hidden_count=_L,
    idle_spike_count=_L,
    time_per_question_mean_s=_D,
    questions_seen=_L,
    attempt_duration_s=_D,
    client_seq_gaps=_L,
    has_submit_event=_B,
)

SIGNAL = _struct(score=_D, components=T.MapType(_S, _D))

# numbers stay text: coerce_log_types decides what an unreadable one becomes
SCORE_LOG = _struct(
    timestamp=_S,
    attempt_id=_S,
    risk=_S,
    confidence=_S,
    confidence_score=_S,
    combined_score=_S,
    features=FEATURES,
    signals=T.MapType(_S, SIGNAL),
    explanation_text=_S,
    explanation=_S,
)

LABELLED_ATTEMPT = _struct(
    attempt_id=_S,
    expected_label=_S,
    candidate=_struct(candidate_id=_S, name=_S, email=_S, cohort=_S, region=_S),
    assessment=_struct(assessment_id=_S, assessment_name=_S),
    events=T.ArrayType(BATCH_EVENT),
    profile=_S,
    is_edge_case=_B,
    edge_case_scenario=_S,
)

#: Folder of an attempt: a letter, as folder names that look like numbers are read as such, and digits of a hash.
ATTEMPT_BUCKET = "attempt_bucket"


def attempt_bucket(attempt_id: Column, digits: int) -> Column:
    return F.concat(F.lit("h"), F.substring(F.md5(F.coalesce(attempt_id, F.lit("")).cast("binary")), 1, digits))


def in_bucket_of(attempt_id: str) -> Column:
    """Whether a folder (of any number of digits) may hold the attempt."""
    return F.lit("h" + hashlib.md5(attempt_id.encode()).hexdigest()).startswith(F.col(ATTEMPT_BUCKET))
