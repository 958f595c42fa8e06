"""Hot attempts go through range slices; results must not change."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from conftest import SMALL, same
from vigilframe.catalog import RULES, delayed_arrival
from vigilframe.config import HotKeys
from vigilframe.operators import features, history, learning, lookup, normalize, patterns, sessions
from vigilframe.operators.timeline import SLICE, Scan, on_timelines, timelines
from vigilframe.plans.progressive import progressive_risk
from vigilframe.plans.score import score_attempts
from vigilframe.sources.fixture import attempt_events

HOT = HotKeys(hot_rows=25, slice_rows=40)


@pytest.fixture(scope="module")
def events(spark):
    rows = attempt_events(spark, SMALL)
    # one attempt with a third of all rows
    hot = F.when(F.col("arrival") % 3 == 0, "hot").otherwise(F.col("attempt_id"))
    return rows.withColumn("attempt_id", hot).cache()


def test_scans_agree_with_plain_windows(spark):
    rng = random.Random(5)
    rows = [
        ("hot" if rng.random() < 0.5 else f"a{rng.randrange(4)}", rng.randrange(30), rng.randrange(3), i, rng.choice([None, 1, 2, 3]), rng.choice("xy"))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "attempt_id string, t_us long, client_seq long, arrival long, v long, g string")
    scans = [Scan(f"{how}_{here}", how, F.col("v"), here) for how in ("last", "sum", "min", "max") for here in (False, True)]
    scans.append(Scan("next", "next", F.col("v")))

    def step(t):
        return t.scan(*scans, by=("g",)).rows.drop(SLICE)

    plain = on_timelines(df, step, limits=HotKeys(hot_rows=None))
    sliced = on_timelines(df, step, limits=HotKeys(hot_rows=60, slice_rows=37))
    assert same(plain, sliced)


def test_slices_are_bounded_even_at_one_instant(spark):
    df = spark.range(4000).select(
        F.lit("hot").alias("attempt_id"), F.lit(7).cast("long").alias("t_us"), F.lit(0).cast("long").alias("client_seq"), F.col("id").alias("arrival")
    )
    cool, hot = timelines(df, limits=HotKeys(hot_rows=100, slice_rows=500))
    assert cool.rows.isEmpty() and hot.sliced
    sizes = [r["count"] for r in hot.rows.groupBy(SLICE).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 6 and max(sizes) < 1200
    ranked = on_timelines(df, lambda t: t.scan(Scan("rn", "sum", F.lit(1).cast("long"), here=True)).rows, limits=HotKeys(100, 500))
    assert ranked.where(F.col("rn") != F.col("arrival") + 1).isEmpty()


@pytest.mark.parametrize(
    "run",
    [
        lambda e, h: score_attempts(e, patterns=RULES, extended=True, limits=h).drop("top_patterns", "summary", "reasons"),
        lambda e, h: features.attempt_features(e, RULES, extended=True, sequences=True, limits=h),
        lambda e, h: patterns.detect_patterns(e, RULES, extended=True, limits=h),
        lambda e, h: progressive_risk(e, rules=RULES, limits=h).drop("top_patterns", "summary", "reasons"),
        lambda e, h: normalize.ordered_events(e, h).drop(SLICE),
        lambda e, h: history.cache_sessions(e, limits=h),
        lambda e, h: history.newest_per_attempt(e, 7, h),
        lambda e, h: sessions.typing_sessions(e, F.col("event_type") == "question_answer", 8.0, h),
        lambda e, h: sessions.idle_sessions(e, limits=h),
        lambda e, h: lookup.prefix_stats(e, limits=h),
        lambda e, h: lookup.asof_event(e, F.col("is_paste"), F.col("is_tab_hidden"), 30.0, limits=h),
    ],
    ids=["score", "features", "patterns", "progressive", "order", "cache", "newest", "typing", "idle", "prefix", "asof"],
)
def test_operators_do_not_change(events, run):
    digits = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    assert same(digits(run(events, HotKeys(hot_rows=None))), digits(run(events, HOT)))


def test_late_events_in_a_hot_attempt(events):
    late = events.withColumn("arrival", delayed_arrival()).where("attempt_id <> 'hot' OR arrival % 5 = 0")
    plain = progressive_risk(late, rules=RULES, limits=HotKeys(hot_rows=None)).drop("top_patterns", "summary", "reasons")
    assert same(plain, progressive_risk(late, rules=RULES, limits=HotKeys(40, 150)).drop("top_patterns", "summary", "reasons"))


def test_many_hot_attempts_without_broadcast(events):
    plain = score_attempts(events, patterns=RULES).select("attempt_id", "risk", "combined_score")
    joined = score_attempts(events, patterns=RULES, limits=HotKeys(10, 100, broadcast_rows=0))
    assert same(plain, joined.select("attempt_id", "risk", "combined_score"))


def test_split_of_a_hot_label_is_exact(spark):
    rows = spark.range(900).select("id", F.when(F.col("id") % 9 == 0, 1).otherwise(0).alias("label"))
    for limits in (HotKeys(hot_rows=None), HotKeys(50, 100)):
        train, test = learning.stratified_split(rows, "label", "id", 0.8, 42, limits)
        assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {0: 640, 1: 80}
        assert train.join(test, "id").isEmpty() and train.count() + test.count() == 900


def test_contradicting_hot_attempts_go_and_consistent_ones_stay(spark):
    rows = [("h", "h", 40), ("bad", "bad", 40), ("bad", "other", 1), ("s", None, 3), ("t", "u", 1), (None, "s", 1), (None, "t", 2)]
    arrivals = [
        (a, own, "focus", "2024-01-01T00:00:01Z", None, "1", n * 100 + k) for n, (a, own, many) in enumerate(rows) for k in range(many)
    ]
    frame = spark.createDataFrame(
        arrivals,
        "attempt_id string, event_attempt_id string, event_type string, occurred_at string, payload string, client_seq string, arrival long",
    )
    for limits in (HotKeys(hot_rows=10), HotKeys(hot_rows=10, broadcast_rows=0), HotKeys(), HotKeys(hot_rows=None)):
        got = {r.attempt_id: r["count"] for r in normalize.normalize_events(frame, limits).groupBy("attempt_id").count().collect()}
        assert got == {"h": 40, "s": 4}, limits
