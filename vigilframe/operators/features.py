"""Marks on every event and the per-attempt features made from them.

``mark`` turns a timeline into one row per event with everything later operators look at: the
previous and next relevant events, the pairs and the pattern candidates. Catalyst drops the windows
that a query does not use. ``attempt_features`` is a single aggregation over the marked rows, which
are already partitioned by attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilframe.config import HotKeys, PatternRules
from vigilframe.operators.normalize import event_flags
from vigilframe.operators.timeline import ORDER, Scan, Timeline, on_timelines

SECOND = 1_000_000
NO_PASTE_ANSWER_S = 999.0
BURST_ANSWER_S = 10.0
BURST_ACTIVITY_S = 35.0


def _at(flag: str) -> Column:
    return F.when(F.col(flag), F.col("t_us"))


def _within(later: Column, earlier: Column, seconds: float) -> Column:
    """Both known and at most so many seconds apart (a negative gap passes)."""
    return F.coalesce(later - earlier <= int(seconds * SECOND), F.lit(False))


def look_around(t: Timeline) -> Timeline:
    """Previous and next relevant events of every row (strictly before / after it)."""
    view = F.col("is_question_enter") | F.col("is_question_leave")
    idle = F.col("is_idle_start") | F.col("is_idle_end")
    tab = F.col("is_tab_hidden") | F.col("is_tab_visible")
    qnum = F.expr("try_cast(regexp_extract(question_id, '[0-9]+', 0) AS BIGINT)")
    return (
        t.map(event_flags)
        .scan(
            Scan("prev_view_action", "last", F.when(view, F.col("action"))),
            Scan("prev_view_us", "last", F.when(view, F.col("t_us"))),
            Scan("prev_idle_state", "last", F.when(idle, F.col("state"))),
            Scan("prev_idle_us", "last", F.when(idle, F.col("t_us"))),
            Scan("prev_tab_state", "last", F.when(tab, F.col("state"))),
            Scan("prev_tab_us", "last", F.when(tab, F.col("t_us"))),
            Scan("last_hidden_us", "last", _at("is_tab_hidden")),
            Scan("last_idle_end_us", "last", _at("is_idle_end")),
            Scan("prev_answer_us", "last", _at("is_answer")),
            Scan("prev_enter_number", "last", F.when(F.col("is_question_enter"), qnum)),
            Scan("prev_seq", "last", F.when(F.col("client_seq") > 0, F.col("client_seq"))),
            Scan("next_leave_us", "next", _at("is_question_leave")),
            Scan("next_answer_us", "next", _at("is_answer")),
        )
        .scan(Scan("last_enter_us", "last", _at("is_question_enter")), by=("question_id",))
        .map(lambda rows: rows.withColumn("question_number", qnum))
    )


def conditions(
    t: Timeline,
    rules: PatternRules = PatternRules(),
    resume: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> Timeline:
    """``look_around`` plus pairs, spikes and pattern candidates.

    ``resume`` may fill in what was seen before the first row of the timeline.
    """
    us = F.col("t_us")
    pair = us - F.col("prev_view_us")
    question_us = F.greatest(us - F.col("last_enter_us"), F.lit(0))

    def add(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                # a leave pairs with the view right before it, if that was an enter
                "question_us": F.when(
                    F.col("is_question_leave") & (F.col("prev_view_action") == "enter") & (pair > 0), pair
                ),
                "is_idle_spike": F.coalesce(
                    F.col("is_idle_end") & (F.col("prev_idle_state") == "idle"), F.lit(False)
                ),
                "idle_us": F.when(
                    F.col("is_idle_end") & (F.col("prev_idle_state") == "idle"), us - F.col("prev_idle_us")
                ),
                "hidden_us": F.when(
                    F.col("is_tab_visible") & (F.col("prev_tab_state") == "hidden"), us - F.col("prev_tab_us")
                ),
                # paste shortly after a tab switch that came after an idle phase
                "is_led_paste": F.col("is_paste")
                & _within(us, F.col("last_hidden_us"), rules.tab_to_paste_s)
                & _within(F.col("last_hidden_us"), F.col("last_idle_end_us"), rules.idle_to_tab_s),
                # quick leave shortly after an idle phase: seconds on the question
                "quick_leave_us": F.when(
                    F.col("is_question_leave")
                    & (F.length("question_id") > 0)
                    & (question_us <= int(rules.fast_answer_s * SECOND))
                    & F.col("last_enter_us").isNotNull()
                    & _within(us, F.col("last_idle_end_us"), rules.idle_to_leave_s),
                    question_us,
                ),
            }
        ).withColumn(
            "is_sequence",
            F.col("is_led_paste") & _within(F.col("next_leave_us"), us, rules.paste_to_leave_s),
        )

    return look_around(t).map(resume).map(add)


def mark(t: Timeline, rules: PatternRules = PatternRules()) -> Timeline:
    """Everything ``aggregate`` needs on the rows."""
    # any order will do for a smallest and second smallest value; rows are already sorted this way
    return conditions(t, rules).scan(
        Scan("best_quick_before", "min", F.col("quick_leave_us")), order=("question_id", *ORDER)
    )


def _base_features(extended: bool) -> dict[str, Column]:
    pairs = F.count("question_us")
    return {
        "paste_count": F.count_if("is_paste"),
        "tab_hidden_count": F.count_if("is_tab_hidden"),
        "idle_spike_count": F.count_if("is_idle_spike"),
        "time_per_question_mean_s": F.coalesce(F.sum("question_us") / F.nullif(pairs, F.lit(0)) / SECOND, F.lit(0.0)),
        "questions_seen": pairs,
        "attempt_duration_s": (F.max("t_us") - F.min("t_us")) / SECOND,
        "client_seq_gaps": (
            F.coalesce(
                F.sum(F.when(F.col("client_seq") > 0, F.greatest(F.col("client_seq") - F.col("prev_seq") - 1, F.lit(0)))),
                F.lit(0),
            )
            if extended
            else F.first(F.lit(0).cast("long"))
        ),
        "has_submit_event": F.bool_or("is_submit") if extended else F.first(F.lit(True)),
        "event_count": F.count("*"),
    }


def sequence_evidence() -> Column:
    """Times of the first complete sequence of an attempt."""
    first = F.when(F.col("is_sequence"), F.struct(*ORDER))
    return F.min_by(
        F.struct("last_idle_end_us", "last_hidden_us", F.col("t_us").alias("paste_us"), "next_leave_us"), first
    )


def second_quick() -> Column:
    """The second smallest of all is the smallest of max(value, smallest before it)."""
    return F.when(
        F.col("quick_leave_us").isNotNull() & F.col("best_quick_before").isNotNull(),
        F.greatest("quick_leave_us", "best_quick_before"),
    )


def _pattern_features() -> dict[str, Column]:
    return {
        "has_sequence": F.coalesce(F.bool_or("is_sequence"), F.lit(False)),
        "quick_leaves": F.count("quick_leave_us"),
        "best_quick_us": F.min("quick_leave_us"),
        "second_quick_us": F.min(second_quick()),
    }


def _ratio_features() -> dict[str, Column]:
    duration = F.max("t_us") - F.min("t_us")

    def share(part: str) -> Column:
        return F.when(duration > 0, F.coalesce(F.sum(part), F.lit(0)) / duration).otherwise(F.lit(0.0))

    return {
        "tab_hidden_ratio": share("hidden_us"),
        "idle_ratio": share("idle_us"),
        "fast_ratio": F.coalesce(
            F.count_if(F.col("question_us") <= int(BURST_ANSWER_S * SECOND)) / F.nullif(F.count("question_us"), F.lit(0)),
            F.lit(0.0),
        ),
    }


def sequence_columns() -> dict[str, Column]:
    """The per-event conditions behind the sequence features."""
    us = F.col("t_us")
    to_answer = F.col("next_answer_us") - us
    return {
        "is_answer_burst": F.col("is_answer") & _within(us, F.col("prev_answer_us"), BURST_ANSWER_S),
        "is_tab_return_answer": F.col("is_tab_visible") & _within(F.col("next_answer_us"), us, BURST_ANSWER_S),
        "paste_answer_us": F.when(F.col("is_paste"), to_answer),
        "is_revisit": F.col("is_question_enter") & F.col("last_enter_us").isNotNull(),
        "is_jump": F.coalesce(
            F.col("is_question_enter") & (F.abs(F.col("question_number") - F.col("prev_enter_number")) > 1),
            F.lit(False),
        ),
        "is_idle_burst": F.col("is_idle_end")
        & _within(F.least("next_leave_us", "next_answer_us"), us, BURST_ACTIVITY_S),
    }


def _sequence_features() -> dict[str, Column]:
    mean = F.avg("question_us")
    return {
        "suspicious_sequence_count": F.count_if("is_sequence"),
        "answer_burst_count": F.count_if("is_answer_burst"),
        "tab_return_fast_answer_count": F.count_if("is_tab_return_answer"),
        "paste_to_answer_seconds_min": F.coalesce(F.min("paste_answer_us") / SECOND, F.lit(NO_PASTE_ANSWER_S)),
        "paste_to_answer_fast_count": F.count_if(F.col("paste_answer_us") <= int(BURST_ANSWER_S * SECOND)),
        "navigation_revisit_count": F.count_if("is_revisit"),
        "question_jump_count": F.count_if("is_jump"),
        "timing_variance_score": F.coalesce(F.stddev_pop("question_us") / mean, F.lit(0.0)),
        "idle_to_activity_burst_count": F.count_if("is_idle_burst"),
    }


def _type_ranks(t: Timeline) -> Timeline:
    """Number of each event among those of its type, for the entropy."""
    return t.scan(Scan("_type_rank", "sum", F.lit(1).cast("long"), here=True), by=("event_type",))


def _entropy() -> Column:
    """Entropy in bits of the event types of an attempt.

    That is log2 n - sum(c log2 c) / n over the counts c of the types; c log2 c is the sum of its steps
    r log2 r - (r - 1) log2 (r - 1) over the numbers r of the events, so one pass over the rows will do.
    """
    n, rank = F.count("*"), F.col("_type_rank")
    step = rank * F.log2(rank) - F.when(rank > 1, (rank - 1) * F.log2(rank - 1)).otherwise(0.0)
    return F.greatest(F.log2(n) - F.sum(step) / n, F.lit(0.0))


def _question_ranks(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rank of each question time in its attempt (from 0) and how many there are, for the quantile."""
    known = F.when(F.col("question_us").isNotNull(), 1).otherwise(0).cast("long")
    order = W.partitionBy(*key).orderBy("question_us", "arrival").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns(
        {
            "_question_rank": F.coalesce(F.sum(known).over(order), F.lit(0)),
            "_questions": F.count("question_us").over(W.partitionBy(*key)),
        }
    )


def _tenth_percentile() -> Column:
    """Interpolated 10 % quantile of the question times: the two values beside its place."""
    spot = (F.col("_questions") - 1) * 0.1
    asked = F.col("question_us").isNotNull()
    low = F.max(F.when(asked & (F.col("_question_rank") == F.floor(spot)), F.col("question_us")))
    high = F.max(F.when(asked & (F.col("_question_rank") == F.ceil(spot)), F.col("question_us")))
    share = F.max(spot - F.floor(spot))
    return F.coalesce((low + (high - low) * share) / SECOND, F.lit(0.0))


def _tenth_of_hot(t: Timeline) -> DataFrame:
    """The same quantile where attempts are sliced by time: question times get slices of their own."""
    values = t.rows.where("question_us IS NOT NULL").select(*t.key, "question_us", "arrival")
    total = values.groupBy(*t.key).agg(F.count("*").alias("_questions"))
    ranked = on_timelines(
        values,
        lambda v: v.scan(
            Scan("_question_rank", "sum", F.lit(1).cast("long")), order=("question_us", "arrival")
        ).rows,
        key=t.key,
        limits=HotKeys(hot_rows=0),
        order=("question_us", "arrival"),
    ).join(F.broadcast(total) if t.small else total, list(t.key))
    picked = ranked.groupBy(*t.key).agg(_tenth_percentile().alias(TENTH))
    every = t.rows.select(*t.key).distinct()
    return every.join(picked, list(t.key), "left").withColumn(TENTH, F.coalesce(TENTH, F.lit(0.0)))


TENTH = "time_per_question_p10_s"
FEATURE_COLUMNS = (
    "paste_count",
    "tab_hidden_count",
    "idle_spike_count",
    "time_per_question_mean_s",
    "questions_seen",
    "attempt_duration_s",
    "client_seq_gaps",
    "has_submit_event",
)
RATIO_COLUMNS = ("tab_hidden_ratio", "time_per_question_p10_s", "fast_ratio", "idle_ratio")
SEQUENCE_COLUMNS = (
    "suspicious_sequence_count",
    "answer_burst_count",
    "tab_return_fast_answer_count",
    "paste_to_answer_seconds_min",
    "paste_to_answer_fast_count",
    "navigation_revisit_count",
    "question_jump_count",
    "timing_variance_score",
    "behavior_entropy_score",
    "idle_to_activity_burst_count",
)


def aggregate(
    marked: Timeline,
    extended: bool = False,
    sequences: bool = False,
    passthrough: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per attempt from marked events.

    ``extended`` adds the ratio features and real gap / submit values; ``sequences`` the sequence
    features; ``passthrough`` names columns of which the first known value is kept; ``extra`` holds
    more aggregates over the marked rows.
    """
    columns = {**_base_features(extended), **_pattern_features(), **(extra or {})}
    if extended:
        columns.update(_ratio_features())
        if not marked.sliced:
            marked = marked.map(lambda rows: _question_ranks(rows, marked.key))
            columns[TENTH] = _tenth_percentile()
    if sequences:
        marked = _type_ranks(marked.map(lambda rows: rows.withColumns(sequence_columns())))
        columns.update(_sequence_features(), behavior_entropy_score=_entropy())
    for name in passthrough:
        at = F.when(F.col(name).isNotNull(), F.struct(*ORDER))
        columns[name] = F.min_by(name, at)
    out = marked.rows.groupBy(*marked.key).agg(*[c.alias(n) for n, c in columns.items()])
    return out.join(_tenth_of_hot(marked), list(marked.key)) if extended and marked.sliced else out


def attempt_features(
    events: DataFrame,
    rules: PatternRules = PatternRules(),
    extended: bool = False,
    sequences: bool = False,
    passthrough: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
    key: Sequence[str] = ("attempt_id",),
    limits: HotKeys = HotKeys(),
) -> DataFrame:
    return on_timelines(
        events,
        lambda t: aggregate(mark(t, rules), extended, sequences, passthrough, extra),
        key=key,
        limits=limits,
    )


def question_durations(events: DataFrame, limits: HotKeys = HotKeys()) -> DataFrame:
    """Every enter-to-leave pair with its seconds."""
    return on_timelines(
        events,
        lambda t: mark(t).rows.where("question_us IS NOT NULL").select(
            "attempt_id", "arrival", "question_id", (F.col("question_us") / SECOND).alias("question_time_s")
        ),
        limits=limits,
    )


def event_counts(events: DataFrame, event_types: Sequence[str]) -> DataFrame:
    """Events per attempt, in all and per given type."""
    return events.groupBy("attempt_id").agg(
        F.count("*").alias("event_count"),
        *[F.count_if(F.col("event_type") == name).alias(f"n_{name}") for name in event_types],
    )
