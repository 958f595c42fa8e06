"""Hand-written attempts for the cases the fixture view cannot give."""

import pytest
from pyspark.sql import functions as F

from vigilframe.config import PatternRules
from vigilframe.operators import features, history, lookup, normalize, patterns, sessions
from vigilframe.operators.patterns import QUICK_LEAVE, SEQUENCE, detect_patterns
from vigilframe.plans.score import score_attempts


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_no_closed_question_is_not_fast(attempts):
    row = one(score_attempts(attempts({"a": [("enter", 0), ("paste", 1)]})))
    assert row.time_per_question_mean_s == 0 and row.avg_time == 100 and row.timing_score == 0.1


def test_leave_pairs_with_the_view_before_it_whatever_its_question(attempts):
    events = attempts(
        {"a": [("enter", 0, "q1"), ("enter", 5, "q2"), ("leave", 9, "q1"), ("leave", 12, "q2"), ("enter", 20, "q3"), ("leave", 20, "q3")]}
    )
    row = one(features.attempt_features(events))
    # only enter q2 (5) -> leave q1 (9); the second leave follows a leave, the last pair lasts 0 s
    assert row.questions_seen == 1 and row.time_per_question_mean_s == 4.0


def test_idle_end_may_follow_the_tab_switch(attempts):
    events = attempts(
        {"a": [("idle", 0), ("active", 1), ("hidden", 10), ("idle", 11), ("active", 20), ("paste", 25), ("paste", 26), ("leave", 40)]}
    )
    row = one(detect_patterns(events).where(F.col("pattern_type") == SEQUENCE))
    assert (row.idle_end_us, row.tab_hidden_us, row.paste_us) == (20_000_000, 10_000_000, 25_000_000)


def test_quick_leaves_match_one_by_one(attempts):
    events = attempts(
        {
            "a": [("hidden", 0), ("hidden", 1), ("hidden", 2), ("idle", 3), ("active", 4)]
            + [(kind, 5 + 4 * i + d, f"q{i}") for i in range(3) for kind, d in (("enter", 0), ("leave", 3))]
        }
    )
    rules = PatternRules(medium_min_questions=3)
    found = detect_patterns(events, rules).where(F.col("pattern_type") == QUICK_LEAVE)
    assert found.count() == 3
    row = one(score_attempts(events, patterns=rules))
    # these and the tab pattern; LOW is promoted
    assert row.pattern_count == 4 and row.risk == "MEDIUM"


def test_quick_leave_keeps_enters_of_a_question(attempts):
    events = attempts(
        {"a": [("hidden", 0), ("hidden", 0.1), ("hidden", 0.2), ("idle", 0.5), ("active", 1), ("enter", 2, "q1"), ("leave", 5, "q1"), ("leave", 7, "q1")]}
    )
    found = detect_patterns(events, PatternRules(medium_min_questions=1)).where(F.col("pattern_type") == QUICK_LEAVE)
    assert sorted(r.question_time_s for r in found.collect()) == [3.0, 5.0]


def test_repeated_idle_counts_once(attempts):
    events = attempts({"a": [("idle", 0), ("idle", 5), ("active", 9), ("active", 10), ("idle", 20), ("active", 30)]})
    assert one(features.attempt_features(events)).idle_spike_count == 2


def test_order_is_time_then_sequence_then_arrival(attempts):
    events = attempts({"a": [("leave", 5, "q1", 2), ("enter", 5, "q1", 1), ("enter", 1, "q1", 9), ("other", 5, "q1", 2)]})
    got = {r.arrival: r.event_rn for r in normalize.ordered_events(events).collect()}
    assert got == {2: 1, 1: 2, 0: 3, 3: 4}


def test_row_order_of_the_input_does_not_matter(attempts):
    spec = {"a": [("enter", 3 * i, f"q{i % 2}") if i % 2 else ("leave", 3 * i, "q0") for i in range(20)]}
    events = attempts(spec)
    shuffled = events.orderBy(F.xxhash64("arrival"))
    a, b = (one(score_attempts(e)).asDict() for e in (events, shuffled))
    assert a == b


def test_unknown_types_count_toward_duration_only(attempts):
    row = one(features.attempt_features(attempts({"a": [("paste", 1), ("other", 61)]})))
    assert row.attempt_duration_s == 60 and row.paste_count == 1


def test_low_data_guard(attempts):
    row = one(score_attempts(attempts({"a": [("enter", 0), ("visible", 5)]})))
    assert row.low_data and row.confidence == 0.1 and row.combined_score == 0
    assert row.explanation_text == "Insufficient behavioral data for reliable analysis."


@pytest.fixture
def arrivals(spark):
    def make(rows):
        schema = "attempt_id string, event_attempt_id string, event_type string, occurred_at string, payload string, client_seq string, arrival long"
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)

    return make


def test_normalize(arrivals):
    raw = arrivals(
        [
            ("a", None, "clipboard", "2024-05-01T10:00:00Z", '{"action":"paste","later":1}', None),
            ("a", "a", "clipboard", "2024-05-01T12:00:00.5+02:00", None, "7"),
            ("a", None, "focus", "soon", "{}", None),
            ("a", None, None, "2024-05-01T10:00:00Z", "{}", None),
            ("a", None, "focus", None, "{}", "x"),
            ("b", "c", "focus", "2024-05-01T10:00:00Z", "{}", None),
            ("b", None, "focus", "2024-05-01T10:00:00Z", "{}", None),
            (None, "d", "focus", "2024-05-01T10:00:00Z", "{}", None),
            ("e", "x", "focus", "never", "{}", None),
            (None, None, "focus", "2024-05-01T10:00:00Z", "{}", None),
        ]
    )
    got = {r.arrival: r for r in normalize.normalize_events(raw).collect()}
    assert sorted(got) == [0, 1, 7]
    assert got[1].t_us - got[0].t_us == 500_000 and got[1].client_seq == 7 and got[0].client_seq == 0
    assert got[0].action == "paste" and got[7].attempt_id == "d"
    reasons = {r.attempt_id: r.reason for r in normalize.rejected_events(raw).collect()}
    assert reasons == {"b": "attempt_id mismatch in events", "e": "No valid events provided", None: "Missing attempt_id"}
    with pytest.raises(ValueError):
        normalize.rejected_events(raw, raise_error=True)


def test_paste_attribution(attempts):
    events = attempts(
        {"a": [("paste", 0, "q1"), ("answer", 1.5, "q1"), ("answer", 1.6, "q2"), ("answer", 2.0, "q1"), ("answer", 2.001, "q1")]}
    )
    got = lookup.paste_attribution(events, F.col("is_answer"), F.lit("small")).orderBy("arrival").collect()
    assert [r.change_type for r in got] == ["paste", "input", "paste", "input"]
    assert [r.paste_recent_ms for r in got] == [1500, None, 2000, 2001]


def test_sessions(attempts):
    events = attempts({"a": [("answer", 0), ("answer", 1.5), ("answer", 3.1), ("blur", 40), ("hidden", 41), ("visible", 45), ("focus", 50)]})
    typed = sessions.typing_sessions(events, F.col("event_type") == "question_answer").orderBy("session").collect()
    assert [(r.keystrokes, r.duration_s) for r in typed] == [(2, 3.0), (1, 1.5)]
    idle = sessions.idle_sessions(events).orderBy("t_us").collect()
    assert [(r.state, r.t_us / 1e6) for r in idle] == [("idle", 3.1), ("active", 40.0)]
    away = {r.kind: r.duration_s for r in sessions.focus_sessions(events).collect()}
    assert away == {"hidden": 4.0, "blurred": 10.0}


def test_latest_per_attempt_overlays(spark):
    rows = spark.createDataFrame(
        [("a", 10, 1, "x", None), ("a", 20, 2, None, "y"), ("a", 15, 3, "late", "late"), ("a", 20, 4, "z", None), ("b", 5, 5, None, None), ("", 1, 6, "n", "n")],
        "attempt_id string, ts long, arrival long, c1 string, c2 string",
    )
    got = [(r.attempt_id, r.ts, r.c1, r.c2) for r in history.latest_per_attempt(rows, "ts", "arrival").collect()]
    assert got == [("b", 5, None, None), ("a", 20, "z", "y")]


def test_cache_sessions_start_over_after_six_hours(spark, attempts):
    hours = [0, 5, 10.9, 17, 17.5]
    events = attempts({"a": [("enter", 0)] * len(hours)}).withColumn(
        "received_us", F.element_at(F.array(*[F.lit(int(h * 3_600_000_000)) for h in hours]), (F.col("arrival") + 1).cast("int"))
    )
    got = [r.session_id for r in history.cache_sessions(events).orderBy("arrival").collect()]
    assert got == [0, 0, 0, 1, 1]


def test_pattern_c_needs_the_ratios(attempts):
    views = [(k, 2 + 10 * i + d, f"q{i}") for i in range(10) for k, d in (("enter", 0), ("leave", 9))]
    tabs = [("hidden", 3), ("visible", 8), ("hidden", 23), ("visible", 28), ("hidden", 43), ("visible", 48)]
    events = attempts({"a": sorted(views + tabs, key=lambda e: e[1])})
    kinds = lambda df: {r.pattern_type for r in df.collect()}
    assert patterns.MEDIUM_TAB not in kinds(detect_patterns(events))
    assert patterns.MEDIUM_TAB in kinds(detect_patterns(events, extended=True))
