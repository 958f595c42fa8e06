"""Risk after every event: the score an attempt had when each of its events had arrived.

Attempts whose events arrive in time order need running aggregates only: every feature of a prefix
is a running sum, minimum or maximum, and a pattern counts from the event that completes it. The
decision expressions are those of the batch plan.

A late event changes what came before it. Attempts that contain late events go through the sweep of ``late``, which
looks again at what a late event changes only. An attempt too large for one task goes through
``_with_late_events`` instead: each instant that brings late events opens a new epoch, and the running
aggregates are continued per epoch, over slices, from where it starts to matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HotKeys, PatternRules, ScoringRules
from vigilframe.functions.review import build_reason
from vigilframe.operators.features import SECOND, conditions, second_quick
from vigilframe.operators.history import cache_sessions
from vigilframe.operators.timeline import ORDER, SLICE, Scan, Timeline, census, on_timelines, timelines
from vigilframe.plans.late import sweep
from vigilframe.plans.score import decide
from vigilframe.session import cut

EPOCH = "_epoch"
NUMBER = "_number"  # of an arrival in its session


# what a timeline that starts in the middle of an attempt has to know of the events before
SEEN = ("prev_view_action", "prev_view_us", "prev_idle_state", "prev_idle_us", "last_hidden_us", "last_idle_end_us")
POINTS = ("_led_at", "_leave_at")
SUMS = (
    "paste_count",
    "tab_hidden_count",
    "idle_spike_count",
    "questions_seen",
    "_question_sum",
    "event_count",
    "_sequences",
    "quick_leaves",
)
LEAST = ("_first_us", "best_quick_us", "second_quick_us")


def running(t: Timeline, rules: PatternRules, here: bool, resumed: bool = False) -> Timeline:
    """Running aggregates up to each event, with it (``here``) or without.

    With ``resumed`` the timeline continues from the values in the ``_b_`` columns.
    """
    before = lambda c: F.col(f"_b_{c}")
    take = lambda columns: (lambda rows: rows.withColumns(columns)) if resumed else (lambda rows: rows)
    at = F.struct(*ORDER)
    led_after_leave = F.col("_led_at").isNotNull() & (
        F.col("_leave_at").isNull() | (F.col("_led_at") > F.col("_leave_at"))
    )
    near = F.col("t_us") - F.col("_led_at")["t_us"] <= int(rules.paste_to_leave_s * SECOND)
    completes = F.col("is_question_leave") & led_after_leave & near
    one = lambda test: F.when(test, 1).otherwise(0).cast("long")
    values = {
        "paste_count": one(F.col("is_paste")),
        "tab_hidden_count": one(F.col("is_tab_hidden")),
        "idle_spike_count": one(F.col("is_idle_spike")),
        "questions_seen": one(F.col("question_us").isNotNull()),
        "_question_sum": F.col("question_us"),
        "event_count": F.lit(1).cast("long"),
        "_sequences": one(completes),
        "quick_leaves": one(F.col("quick_leave_us").isNotNull()),
        "_first_us": F.col("t_us"),
        "best_quick_us": F.col("quick_leave_us"),
        "second_quick_us": second_quick(),
    }
    seen = {c: F.coalesce(F.col(c), before(c)) for c in (*SEEN, "last_enter_us")}
    points = {c: F.coalesce(F.col(c), before(c)) for c in POINTS}
    points["best_quick_before"] = F.least(F.col("best_quick_before"), before("best_quick_us"))
    totals = {c: F.col(c) + F.coalesce(before(c), F.lit(0)) for c in SUMS}
    totals |= {c: F.least(F.col(c), before(c)) for c in LEAST}
    return (
        conditions(t, rules, take(seen))
        .scan(
            Scan("best_quick_before", "min", F.col("quick_leave_us")),
            Scan("_led_at", "last", F.when(F.col("is_led_paste"), at)),
            Scan("_leave_at", "last", F.when(F.col("is_question_leave"), at)),
        )
        .map(take(points))
        .scan(*[Scan(c, "sum" if c in SUMS else "min", v, here=here) for c, v in values.items()])
        .map(take(totals))
    )


def prefix_features(t: Timeline, rules: PatternRules = PatternRules(), resumed: bool = False) -> Timeline:
    """The feature columns of ``attempt_features`` for every prefix of the timeline."""
    return running(t, rules, here=True, resumed=resumed).map(lambda rows: _features(rows, F.col("t_us")))


def _features(rows: DataFrame, newest_us: Column) -> DataFrame:
    """The feature columns that follow from running totals."""
    mean = F.col("_question_sum") / F.nullif(F.col("questions_seen"), F.lit(0)) / SECOND
    return rows.withColumns(
        {
            "time_per_question_mean_s": F.coalesce(mean, F.lit(0.0)),
            "attempt_duration_s": (newest_us - F.col("_first_us")) / SECOND,
            "client_seq_gaps": F.lit(0).cast("long"),
            "has_submit_event": F.lit(True),
            "has_sequence": F.col("_sequences") > 0,
        }
    )


def _late_states(
    events: DataFrame, key: tuple[str, ...], rules: PatternRules, after: int | None, limits: HotKeys
) -> DataFrame:
    """Prefix features of attempts with late events: a sweep for each, epochs for those too large for one task."""
    parts = []
    for t in timelines(events, key, limits):
        if t.sliced:
            parts.append(_with_late_events(t.rows.drop(SLICE), key, rules, after, limits))
        else:
            totals = sweep(t.rows, key, EPOCH, rules, after)
            parts.append(_features(totals, F.col("_newest_us")).select(*key, "arrival", *STATE_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def _with_late_events(
    events: DataFrame, key: tuple[str, ...], rules: PatternRules, after: int | None, limits: HotKeys
) -> DataFrame:
    """Prefix features of attempts with late events; ``_epoch`` numbers the instants that brought some.

    In epoch e the events of earlier epochs and the late events that opened it are old; the late ones
    get the state at the last old event. Later events of the epoch come in order and read their own
    state.

    An epoch is not rebuilt from the first event. Before its start, the earliest place that this or a
    later epoch inserts at, nothing is missing yet, so there one pass over all events in final order
    knows the state. Only events from the start on are looked at again: an event takes part in as many
    epochs as insert before it after its arrival. Epochs that end before the first wanted arrival
    are not built.
    """
    place = F.struct("t_us", "arrival")
    opened = events.where("_late").groupBy(*key, EPOCH).agg(F.min(place).alias("_place"))
    starts = cut(
        on_timelines(
            opened.withColumn("_back", -F.col(EPOCH)),
            lambda t: t.scan(Scan("_start", "min", F.col("_place"), here=True), order=("_back",)).rows,
            key=key,
            limits=limits,
            order=("_back",),
        ).select(*key, F.col(EPOCH).alias("_as_of"), "_place", "_start")
    )
    firsts = starts.where("_start = _place").select(
        *key, F.col("_place.arrival").alias("arrival"), F.col("_as_of").alias("_starts_here")
    )
    carried = (*SEEN, *POINTS, *SUMS, *LEAST)
    final = cut(
        on_timelines(
            events.join(firsts, [*key, "arrival"], "left"),
            lambda t: running(t, rules, here=False)
            .scan(Scan("_until", "max", F.col("_starts_here"), here=True))
            .rows.select(*events.columns, "_starts_here", "_until", "is_question_enter", *carried),
            key=key,
            limits=limits,
        )
    )
    base = (
        starts.select(*key, "_as_of", F.col("_start.arrival").alias("arrival"))
        .join(final.where("_starts_here IS NOT NULL").select(*key, "arrival", *carried), [*key, "arrival"])
        .select(*key, "_as_of", *[F.col(c).alias(f"_b_{c}") for c in carried])
    )
    if starts.count() <= limits.broadcast_rows:
        base = F.broadcast(base)
    # an enter matters to a leave of its question for a bounded time only
    span = int(rules.fast_answer_s * SECOND)
    bucket = F.floor(F.col("t_us") / span)
    start_bucket = F.floor(F.col("_start.t_us") / span)
    entered = (
        starts.select(*key, "_as_of", "_start", F.explode(F.array(start_bucket, start_bucket - 1)).alias("_bucket"))
        .join(
            final.where("is_question_enter").select(*key, "question_id", place.alias("_entered"), bucket.alias("_bucket")),
            [*key, "_bucket"],
        )
        .where("_entered < _start")
        .groupBy(*key, "_as_of", "question_id")
        .agg(F.max("_entered.t_us").alias("_b_last_enter_us"))
    )
    last = F.greatest(F.col(EPOCH), F.coalesce("_until", F.lit(0)))
    first = F.col(EPOCH)
    rows = final.select(*events.columns, "_until")
    if after is not None:
        done = F.col("arrival") <= F.lit(after)
        reached = events.groupBy(*key).agg(F.coalesce(F.max(F.when(done, F.col(EPOCH))), F.lit(0)).alias("_reached"))
        rows, first = rows.join(reached, list(key)), F.greatest(EPOCH, "_reached")
    per_epoch = (
        rows.withColumn("_as_of", F.explode(F.when(first <= last, F.sequence(first, last))))
        .withColumn("_old", (F.col(EPOCH) < F.col("_as_of")) | F.col("_late"))
        .join(base, [*key, "_as_of"], "left")
        .join(entered, [*key, "_as_of", "question_id"], "left")
    )
    last_old = F.col("_old") & F.col("_older_next").isNull() & (F.col("_as_of") > 0)

    def step(t: Timeline) -> DataFrame:
        seen = prefix_features(t, rules, resumed=True).scan(
            Scan("_older_next", "next", F.when(F.col("_old"), F.col("arrival")))
        )
        return seen.rows.where(last_old | ~F.col("_old")).select(*key, "_as_of", "_old", "arrival", *STATE_COLUMNS)

    states = cut(on_timelines(per_epoch, step, key=(*key, "_as_of"), limits=limits))
    late = events.where("_late").select(*key, F.col(EPOCH).alias("_as_of"), "arrival")
    merged = states.where("_old").drop("arrival").join(late, [*key, "_as_of"])
    return states.where("NOT _old").unionByName(merged).drop("_old", "_as_of")


STATE_COLUMNS = (
    "paste_count",
    "tab_hidden_count",
    "idle_spike_count",
    "time_per_question_mean_s",
    "questions_seen",
    "attempt_duration_s",
    "client_seq_gaps",
    "has_submit_event",
    "event_count",
    "has_sequence",
    "quick_leaves",
    "best_quick_us",
    "second_quick_us",
)


def progressive_risk(
    events: DataFrame,
    scoring: ScoringRules = ScoringRules(),
    rules: PatternRules = PatternRules(),
    ttl_s: float | None = None,
    passthrough: Sequence[str] = (),
    after_arrival: int | None = None,
    instant: str = "arrival",
    limits: HotKeys = HotKeys(),
    predict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One history row per event, in the order of arrival; ``ttl_s`` starts over after a long silence.

    The ingest path does not keep the client sequence, so equal times are ordered by arrival. With
    ``after_arrival`` only rows of later arrivals are returned. ``instant`` names what events were
    received together (a micro-batch, say): its late events are merged before any of them is scored.

    With a column ``usable`` every arrival counts and gets a row: one that cannot be scored repeats the
    score before it, if its session has one. ``predict`` names columns ``ml_risk`` and ``ml_confidence`` from
    the feature rows of every prefix.
    """
    key = ("attempt_id", "session_id")
    order = ("arrival",)
    limits = census(events, limits)
    rows = cache_sessions(events.withColumn("client_seq", F.lit(0).cast("long")), ttl_s, limits=limits)
    every = "usable" in events.columns
    if every:
        rows = on_timelines(
            rows,
            lambda t: t.scan(Scan(NUMBER, "sum", F.lit(1).cast("long"), here=True), order=order).rows,
            key=key,
            limits=limits,
            order=order,
        )
        passthrough = (*passthrough, NUMBER)
        unusable = rows.where("NOT usable")
        rows = rows.where("usable")
    late = F.coalesce(F.col("t_us") < F.col("_newest"), F.lit(False))
    opens = F.col("_late") & (F.col("_late_before").isNull() | (F.col("_late_before") != F.col(instant)))
    rows = on_timelines(
        rows,
        lambda t: t.scan(Scan("_newest", "max", F.col("t_us")), order=order)
        .map(lambda r: r.withColumn("_late", late))
        .scan(Scan("_late_before", "last", F.when(F.col("_late"), F.col(instant))), order=order)
        .scan(Scan(EPOCH, "sum", opens.cast("long"), here=True), order=order)
        .rows.drop("_newest", "_late_before"),
        key=key,
        limits=limits,
        order=order,
    )
    disordered = cut(rows.where("_late").select(*key).distinct())
    found = disordered.count()
    ordered = rows
    if found:
        side = F.broadcast(disordered) if found <= limits.broadcast_rows else disordered
        ordered = rows.join(side, list(key), "left_anti")
    kept = [*key, "arrival", *STATE_COLUMNS]
    states = on_timelines(
        ordered, lambda t: prefix_features(t, rules).rows.select(*kept, *passthrough), key=key, limits=limits
    )
    if found:
        redone = _late_states(rows.join(side, list(key), "left_semi"), key, rules, after_arrival, limits)
        if passthrough:
            redone = redone.join(rows.select(*key, "arrival", *passthrough), [*key, "arrival"])
        states = states.unionByName(redone)
    if every:
        states = with_unusable(states, unusable, key, passthrough, limits)
    if after_arrival is not None:
        states = states.where(F.col("arrival") > after_arrival)
    return finished(states, scoring, rules, predict)


def finished(
    states: DataFrame, scoring: ScoringRules, rules: PatternRules, predict: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """Decisions and reasons from the state after each event."""
    return decide(states, scoring, rules, predict=predict).withColumn(
        "reason", build_reason(F.col("risk"), F.col("explanation_text"))
    )


def with_unusable(
    states: DataFrame, unusable: DataFrame, key: tuple[str, ...], passthrough: Sequence[str], limits: HotKeys
) -> DataFrame:
    """Every arrival with the state after it; ``event_count`` counts them all."""
    missing = [F.lit(None).cast(states.schema[c].dataType).alias(c) for c in STATE_COLUMNS]
    both = states.withColumn("_known", F.lit(True)).unionByName(
        unusable.select(*key, "arrival", *missing, *passthrough).withColumn("_known", F.lit(None).cast("boolean"))
    )
    last = Scan("_state", "last", F.when(F.col("_known"), F.struct(*STATE_COLUMNS)), here=True)
    return on_timelines(
        both,
        lambda t: t.scan(last, order=("arrival",)).rows.where("_state IS NOT NULL"),
        key=key,
        limits=limits,
        order=("arrival",),
    ).select(
        *key,
        "arrival",
        *[(F.col(NUMBER) if c == "event_count" else F.col(f"_state.{c}")).alias(c) for c in STATE_COLUMNS],
        *[c for c in passthrough if c != NUMBER],
    )
