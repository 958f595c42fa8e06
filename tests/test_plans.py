"""The physical plans we want."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from vigilframe.catalog import QUERIES, RULES, _stand_in, log_rows
from vigilframe.config import HotKeys
from vigilframe.operators import reports, timeline
from vigilframe.operators.features import attempt_features
from vigilframe.operators.history import newest_per_attempt
from vigilframe.operators.normalize import normalize_events, ordered_events
from vigilframe.operators.patterns import detect_patterns
from vigilframe.plans.progressive import progressive_risk
from vigilframe.plans.score import score_attempts
from vigilframe.sources.fixture import attempt_events, raw_events

WITHOUT_CHECK = HotKeys(hot_rows=None)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", plan))


def test_scoring_needs_one_exchange(spark):
    plan = plan_of(score_attempts(attempt_events(spark, SMALL), patterns=RULES, limits=WITHOUT_CHECK))
    assert exchanges(plan) == 1
    assert plan.count(" Sort [") == 3
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_size_check_adds_no_exchange_to_the_plan(spark):
    plan = plan_of(score_attempts(attempt_events(spark, SMALL), patterns=RULES))
    assert exchanges(plan) == 1


def test_progressive_in_order_needs_one_exchange(spark):
    # attempts with late events are looked up before, in a pass over three columns
    plan = plan_of(progressive_risk(attempt_events(spark, SMALL), rules=RULES, limits=WITHOUT_CHECK))
    assert exchanges(plan) == 1 and "Python" not in plan


def test_every_attempt_operator_needs_one_scan_and_one_exchange(spark):
    events = lambda: attempt_events(spark, SMALL)
    frames = {
        "extended": attempt_features(events(), RULES, extended=True, limits=WITHOUT_CHECK),
        "sequences": attempt_features(events(), RULES, sequences=True, limits=WITHOUT_CHECK),
        "patterns": detect_patterns(events(), RULES, limits=WITHOUT_CHECK),
        "extended patterns": detect_patterns(events(), RULES, extended=True, limits=WITHOUT_CHECK),
        "newest": newest_per_attempt(events(), 5, WITHOUT_CHECK),
        "model": score_attempts(events(), patterns=RULES, limits=WITHOUT_CHECK, predict=_stand_in),
    }
    for name, rows in frames.items():
        plan = plan_of(rows)
        assert (exchanges(plan), plan.count("FileScan")) == (1, 1), name


def test_unused_windows_are_pruned(spark):
    plan = plan_of(QUERIES["f_paste_count"](spark, SMALL))
    assert "Window" not in plan


def test_one_count_for_all_steps_of_a_plan(spark):
    """Attempts are counted once for all sessions, epochs and scans on them."""
    counted = []
    real = timeline.timelines

    def seen(events, key, limits, order):
        counted.append(limits.hot_rows)
        return real(events, key, limits, order)

    timeline.timelines, kept = seen, timeline.timelines
    try:
        progressive_risk(attempt_events(spark, SMALL), rules=RULES, ttl_s=3600.0)
    finally:
        timeline.timelines = kept
    assert len(counted) >= 3 and set(counted) == {None}


def test_filter_on_the_decision_stays_small(spark):
    rows = score_attempts(attempt_events(spark, SMALL), patterns=RULES, limits=WITHOUT_CHECK)
    plan = plan_of(rows.where("risk = 'HIGH'").select("attempt_id", "risk"))
    assert len(plan) < 40_000


def test_top_k_does_not_sort_everything(spark):
    log = log_rows(spark, SMALL)
    assert "TakeOrderedAndProject" in plan_of(reports.top_alerts(log, time="timestamp_us"))
    assert "TakeOrderedAndProject" in plan_of(reports.log_explorer(log, time="timestamp_us"))


def test_panels_limit_before_the_shuffle(spark):
    attempts = spark.range(1000).select(
        F.col("id").cast("string").alias("attempt_id"), F.col("id").alias("timestamp"), F.lit("ONGOING").alias("status"), F.lit("HIGH").alias("risk")
    )
    assert plan_of(reports.panel_top(attempts)).count("WindowGroupLimit") == 2


def test_no_python_in_any_batch_plan(spark):
    for name in ("detect_patterns", "cache_sessions", "typing_sessions", "latest_per_attempt", "ml_features_refine", "review_queue"):
        assert "Python" not in plan_of(QUERIES[name](spark, SMALL)), name


def test_registered_queries_have_hashable_columns(spark):
    from checks.oracle import ORACLE

    assert set(ORACLE) <= set(QUERIES)
    df = QUERIES["score_attempts"](spark, SMALL)
    assert not any(isinstance(f.dataType, (T.MapType, T.ArrayType)) for f in df.schema)


def test_contradicting_attempts_are_found_in_the_exchange_of_the_scans(spark):
    raw = raw_events(spark, SMALL)
    started = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    canonical = normalize_events(raw, WITHOUT_CHECK)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == started
    for rows in (canonical, ordered_events(canonical, WITHOUT_CHECK)):
        plan = plan_of(rows)
        assert (exchanges(plan), plan.count("FileScan")) == (1, 1)
        assert "Join" not in plan and "RDD" not in plan
