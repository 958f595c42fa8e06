"""The sweep over late events against scoring every prefix from scratch."""

import random

from pyspark.sql import functions as F

from conftest import SECOND, same
from vigilframe.config import HotKeys, PatternRules
from vigilframe.plans.late import Attempt
from vigilframe.plans.progressive import progressive_risk
from vigilframe.plans.score import score_attempts

RULES = PatternRules()
KINDS = ["is_paste", "is_tab_hidden", "is_idle_start", "is_idle_end", "is_question_enter", "is_question_leave", None]


def scratch(events):
    """Totals of a prefix, by one walk over its events in order."""
    view = idle = hidden = ended = led = leave = None
    entered = {}
    pastes = hides = spikes = question_sum = pairs = sequences = 0
    quick = []
    for t, arrival, kind, question in sorted(events):
        at = (t, arrival)
        if kind == "is_paste":
            pastes += 1
            if hidden and ended and t - hidden[0] <= 30 * SECOND and hidden[0] - ended[0] <= 45 * SECOND:
                led = at
        elif kind == "is_tab_hidden":
            hides, hidden = hides + 1, at
        elif kind == "is_idle_start":
            idle = "idle"
        elif kind == "is_idle_end":
            spikes += idle == "idle"
            idle, ended = "active", at
        elif kind == "is_question_enter":
            view = ("enter", t)
            if question is not None:
                entered[question] = t
        elif kind == "is_question_leave":
            if view and view[0] == "enter" and t > view[1]:
                question_sum, pairs = question_sum + t - view[1], pairs + 1
            view = ("leave", t)
            sequences += bool(led and (leave is None or led > leave) and t - led[0] <= 30 * SECOND)
            leave = at
            took = t - entered[question] if question and question in entered else None
            if took is not None and took <= 10 * SECOND and ended and t - ended[0] <= 35 * SECOND:
                quick.append(took)
    quick.sort()
    times = [e[0] for e in events]
    return (
        pastes, hides, spikes, question_sum if pairs else None, pairs, min(times), max(times), len(events), sequences,
        len(quick), quick[0] if quick else None, quick[1] if len(quick) > 1 else None,
    )


def random_events(rng, n, span):
    kinds = rng.choices(KINDS, weights=[rng.random() for _ in KINDS], k=n)
    return [(rng.randint(0, span) * SECOND // 2, i, k, rng.choice(["q1", "q2", "q3", "", None])) for i, k in enumerate(kinds)]


def test_every_prefix_of_random_attempts():
    rng = random.Random(11)
    for _ in range(300):
        events, state = random_events(rng, rng.randint(1, 60), rng.choice([5, 60, 400])), Attempt(RULES)
        if rng.random() < 0.5:  # mostly in order
            events = [(t, i, k, q) for i, (t, _, k, q) in enumerate(sorted(events, key=lambda e: e[0] + rng.choice([0, 0, 0, 20 * SECOND])))]
        for n, event in enumerate(events):
            state.insert(*event)
            assert state.totals() == scratch(events[: n + 1])


def made(spark, n):
    """An attempt of n events in order, then n that fall between them, the latest first."""
    return spark.range(2 * n).select(
        F.lit("a").alias("attempt_id"),
        F.element_at(F.array(*[F.lit(k) for k in ("question_view", "clipboard", "visibility_change", "idle_state")]), (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
        F.when(F.col("id") % 4 == 1, "paste").when(F.col("id") % 8 == 0, "enter").otherwise("leave").alias("action"),
        F.when(F.col("id") % 4 == 2, "hidden").when(F.col("id") % 8 == 3, "idle").otherwise("active").alias("state"),
        F.concat(F.lit("q"), (F.col("id") % 3).cast("string")).alias("question_id"),
        (F.when(F.col("id") < n, F.col("id") * 2).otherwise((2 * n - F.col("id")) * 2 - 1) * SECOND).alias("t_us"),
        F.lit(0).cast("long").alias("client_seq"),
        F.col("id").alias("arrival"),
    )


def test_many_very_late_arrivals(spark):
    events = made(spark, 10_000)
    states = progressive_risk(events)
    assert states.count() == 20_000
    last = states.where("arrival = 19999").select("attempt_id", "risk", "combined_score", "pattern_count", "event_count")
    assert same(score_attempts(events).select(*last.columns), last)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.replace("Generate inline", "")  # no event is copied per late arrival


def test_attempts_beyond_a_task_take_the_plain_way(spark):
    events = made(spark, 60)
    columns = ["arrival", "risk", "combined_score", "pattern_count", "event_count", "explanation_text"]
    sliced = progressive_risk(events, limits=HotKeys(hot_rows=10, slice_rows=25))
    assert same(progressive_risk(events).select(*columns), sliced.select(*columns))
