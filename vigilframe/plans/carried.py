"""Risk after every event of a micro-batch, continued from what was kept of each attempt.

What a timeline has to know of the events before it is one row per attempt: the last view, idle phase, tab switch and
led paste, running sums and least values, and the questions entered just now. ``continued`` lays
that row before the new events of an attempt and runs the same aggregates over the new events only; the row after
them is read off a marker at the end. Attempts to which an event came late are named by ``reached_back`` and
have to be scored from their stored events; ``carried_over`` gives their row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import HotKeys, PatternRules, ScoringRules
from vigilframe.operators.features import SECOND
from vigilframe.operators.history import cache_sessions
from vigilframe.operators.timeline import Scan, census, on_timelines
from vigilframe.plans.progressive import (
    LEAST,
    NUMBER,
    POINTS,
    SEEN,
    STATE_COLUMNS,
    SUMS,
    finished,
    prefix_features,
    with_unusable,
)

KEY = ("attempt_id", "session_id")
CARRIED = (*SEEN, *POINTS, *SUMS, *LEAST)
#: One row per attempt: its open session, what is carried, and when it was last heard of.
KEPT = ("session_start_us", "last_received_us", "newest_us", "arrivals", "entered", *CARRIED)
START, END = -1, 1 << 62  # arrivals of the markers before and after the new events
PLACE = "struct<t_us:bigint,client_seq:bigint,arrival:bigint>"
KINDS = {c: "string" if c in ("prev_view_action", "prev_idle_state") else PLACE if c in POINTS else "long" for c in CARRIED}
KINDS |= dict.fromkeys(KEPT[:4], "long") | {"entered": "array<struct<question_id:string,t_us:bigint>>"}


def sessions(events: DataFrame, kept: DataFrame | None, ttl_s: float | None, limits: HotKeys = HotKeys()) -> DataFrame:
    """New events by session, with the kept row (``_b_`` columns) where they go on with the session that it is of."""
    rows = cache_sessions(events.withColumn("client_seq", F.lit(0).cast("long")), ttl_s, limits=limits)
    if kept is None:
        return rows.withColumns({f"_b_{c}": F.lit(None).cast(KINDS[c]) for c in KEPT})
    rows = rows.join(kept.select("attempt_id", *[F.col(c).alias(f"_b_{c}") for c in KEPT]), "attempt_id", "left")
    on = F.col("_b_arrivals").isNotNull() & (F.col("session_id") == 0)
    if ttl_s is not None:
        on &= F.col("session_start_us") - F.col("_b_last_received_us") <= int(ttl_s * SECOND)
    rows = rows.withColumn("_on", F.coalesce(on, F.lit(False)))
    rows = rows.withColumns({f"_b_{c}": F.when(F.col("_on"), F.col(f"_b_{c}")) for c in KEPT})
    start = F.when(F.col("_on"), F.col("_b_session_start_us")).otherwise(F.col("session_start_us"))
    return rows.withColumn("session_start_us", start).drop("_on")


def reached_back(rows: DataFrame) -> DataFrame:
    """Attempts with a new event that is older than one that came in an earlier batch."""
    return rows.where("usable AND t_us < _b_newest_us").select("attempt_id").distinct()


def _timeline(
    rows: DataFrame,
    rules: PatternRules,
    passthrough: Sequence[str],
    limits: HotKeys,
    pin: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """States after every usable event and after the markers, and one row about each session's arrivals.

    The marker before the events repeats the state that is carried; the one after them has seen all.
    """
    before = [f"_b_{c}" for c in KEPT]
    about = rows.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in ("session_start_us", *before)],
        F.max("received_us").alias("last_received_us"),
        F.count("*").alias("_new"),
        F.max(F.when(F.col("usable"), F.col("t_us"))).alias("_newest"),
    )
    about = about.withColumns(
        {
            "newest_us": F.greatest("_newest", "_b_newest_us"),
            "arrivals": F.col("_new") + F.coalesce("_b_arrivals", F.lit(0)),
        }
    )
    about = pin(about)  # both markers and the kept rows are made from it
    at = lambda place, t_us: about.where(t_us.isNotNull()).select(
        *KEY, *before, t_us.alias("t_us"), F.lit(place).cast("long").alias("arrival"), F.lit(0).cast("long").alias("client_seq")
    )
    marks = at(START, F.col("_b_newest_us")).unionByName(at(END, F.col("newest_us")))
    both = rows.where("usable").unionByName(marks, allowMissingColumns=True)
    entered = F.filter("_b_entered", lambda e: e["question_id"] == F.col("question_id"))
    both = both.withColumn("_b_last_enter_us", F.get(F.transform(entered, lambda e: e["t_us"]), F.lit(0)))
    columns = [*KEY, "arrival", "t_us", *STATE_COLUMNS, *CARRIED, *passthrough]
    columns = list(dict.fromkeys(columns))
    states = on_timelines(both, lambda t: prefix_features(t, rules, resumed=True).rows.select(*columns), key=KEY, limits=limits)
    return states, about


def _entered(rows: DataFrame, about: DataFrame, rules: PatternRules) -> DataFrame:
    """The time at which each question was entered last, by session."""
    enter = F.col("usable") & (F.col("event_type") == "question_view") & (F.col("action") == "enter")
    new = rows.where(enter & F.col("question_id").isNotNull()).select(*KEY, "question_id", "t_us")
    old = about.select(*KEY, F.inline("_b_entered"))
    return new.unionByName(old).groupBy(*KEY, "question_id").agg(F.max("t_us").alias("t_us"))


def _kept_rows(rows: DataFrame, states: DataFrame, about: DataFrame, rules: PatternRules) -> DataFrame:
    """What to keep of the last session of each attempt."""
    last = about.withColumn("_last", F.max("session_id").over(Window.partitionBy("attempt_id")))
    last = last.where("session_id = _last").select(*KEY, "session_start_us", "last_received_us", "newest_us", "arrivals")
    ends = states.where(F.col("arrival") == END).select(*KEY, *CARRIED)
    # an enter matters to a leave of its question for a bounded time only
    span = int(rules.fast_answer_s * SECOND)
    recent = _entered(rows, about, rules).join(last.select(*KEY, "newest_us"), list(KEY)).where(F.col("t_us") >= F.col("newest_us") - span)
    recent = recent.groupBy(*KEY).agg(F.collect_list(F.struct("question_id", "t_us")).alias("entered"))
    return last.join(ends, list(KEY), "left").join(recent, list(KEY), "left").select("attempt_id", *KEPT)


def continued(
    rows: DataFrame,
    scoring: ScoringRules,
    rules: PatternRules,
    passthrough: Sequence[str] = (),
    limits: HotKeys = HotKeys(),
    predict: Callable[[DataFrame], DataFrame] | None = None,
    pin: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """History rows of the new events (``sessions`` without late ones), and the rows to keep.

    ``pin`` writes the states down, as both results are made from them.
    """
    number = Scan(NUMBER, "sum", F.lit(1).cast("long"), here=True)
    rows = on_timelines(rows, lambda t: t.scan(number, order=("arrival",)).rows, key=KEY, limits=limits, order=("arrival",))
    rows = rows.withColumn(NUMBER, F.col(NUMBER) + F.coalesce("_b_arrivals", F.lit(0)))
    carry = [*passthrough, NUMBER]
    states, about = _timeline(rows, rules, carry, limits, pin)
    states = pin(states)
    new = states.where(F.col("arrival") < END).select(*KEY, "arrival", *STATE_COLUMNS, *carry)
    every = with_unusable(new, rows.where("NOT usable"), KEY, carry, limits)
    history = finished(every.where(F.col("arrival") > START), scoring, rules, predict)
    return history, _kept_rows(rows, states, about, rules)


def carried_over(events: DataFrame, ttl_s: float | None, rules: PatternRules, limits: HotKeys = HotKeys()) -> DataFrame:
    """The rows to keep of attempts of which all events are given."""
    limits = census(events, limits)
    rows = sessions(events, None, ttl_s, limits)
    states, about = _timeline(rows, rules, (), limits)
    return _kept_rows(rows, states, about, rules)
