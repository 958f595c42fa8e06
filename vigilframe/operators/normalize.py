"""From raw arrivals to the canonical event frame.

Arrivals carry ``attempt_id`` (of the envelope, may be null), ``event_attempt_id`` (of the event
itself, may be null), ``event_type``, ``occurred_at`` (text), ``payload`` (JSON text), ``client_seq``
and ``arrival`` (position of arrival, unique per attempt). The canonical frame has the event time as
``t_us`` and the payload keys the operators need as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilframe.config import HotKeys
from vigilframe.functions.scalar import parse_event_time
from vigilframe.operators.timeline import ORDER, Scan, on_timelines
from vigilframe.schema import PAYLOAD
from vigilframe.session import cut

LIFTED = ("action", "state", "question_id")


def _lifted(arrivals: DataFrame) -> DataFrame:
    """Parse the payload once; columns that are already there stay."""
    if "payload" not in arrivals.columns:
        return arrivals
    keep = [c for c in LIFTED if c not in arrivals.columns]
    parsed = arrivals.withColumn("_p", F.from_json("payload", PAYLOAD))
    return parsed.withColumns({c: F.col(f"_p.{c}") for c in keep}).drop("_p")


def _time_us() -> Column:
    return F.unix_micros(parse_event_time(F.col("occurred_at")))


def _checked(arrivals: DataFrame) -> DataFrame:
    """Add the parsed time and whether the row can be scored or contradicts its envelope."""
    usable = F.col("event_type").isNotNull() & F.col("t_us").isNotNull()
    own = F.col("event_attempt_id") if "event_attempt_id" in arrivals.columns else F.lit(None).cast("string")
    return (
        arrivals.withColumn("t_us", _time_us())
        .withColumn("usable", usable)
        .withColumn(
            "mismatch",
            F.col("usable") & own.isNotNull() & F.col("attempt_id").isNotNull() & (own != F.col("attempt_id")),
        )
    )


def rejected_events(arrivals: DataFrame, raise_error: bool = False) -> DataFrame:
    """One row per attempt that cannot be scored, with the reason."""
    seen = (
        _checked(arrivals)
        .withColumn("attempt_id", F.coalesce("attempt_id", "event_attempt_id"))
        .groupBy("attempt_id")
        .agg(
            F.count("*").alias("events"),
            F.count_if("usable").alias("usable"),
            F.count_if("mismatch").alias("mismatches"),
        )
    )
    reason = (
        F.when(F.col("mismatches") > 0, "attempt_id mismatch in events")
        .when(F.col("usable") == 0, "No valid events provided")
        .when(F.length(F.coalesce("attempt_id", F.lit(""))) == 0, "Missing attempt_id")
    )
    out = seen.withColumn("reason", reason).where("reason IS NOT NULL").select("attempt_id", "events", "reason")
    if raise_error:
        first = out.first()
        if first is not None:
            raise ValueError(f"{first['reason']}: {first['attempt_id']}")
    return out


def unusable_reason() -> Column:
    """Why a checked row cannot be scored; null if it can."""
    return (
        F.when(F.length(F.coalesce("attempt_id", F.lit(""))) == 0, "Missing attempt_id")
        .when(F.col("event_type").isNull(), "Missing event_type")
        .when(_time_us().isNull(), "Unreadable time")
    )


def _consistent(checked: DataFrame, limits: HotKeys) -> DataFrame:
    """Rows of attempts without a contradicting event.

    The check is a column over the whole attempt, made in the exchange and the sort that ordered scans use
    anyway. Attempts above ``limits.hot_rows`` would be one task that way: they get it from an aggregate.
    """
    attempt = F.coalesce("attempt_id", "event_attempt_id")
    rows = checked.withColumn("attempt_id", attempt).where(F.length("attempt_id") > 0)
    order = [c for c in ORDER if c in rows.columns]
    whole = W.partitionBy("attempt_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fused = lambda part: part.withColumn("_bad", F.bool_or("mismatch").over(whole)).where(~F.col("_bad")).drop("_bad")
    if limits.hot_rows is None:
        return fused(rows)
    sizes = rows.groupBy("attempt_id").agg(F.count("*").alias("_n"), F.bool_or("mismatch").alias("_bad"))
    above = sizes.where(F.col("_n") > limits.hot_rows)
    if above.isEmpty():
        return fused(rows)
    hot = cut(above.select("attempt_id", "_bad"))
    hot = F.broadcast(hot) if hot.count() <= limits.broadcast_rows else hot
    good = rows.join(hot.where("NOT _bad").select("attempt_id"), "attempt_id", "left_semi")
    ordinary = rows.join(hot.select("attempt_id"), "attempt_id", "left_anti")
    return fused(ordinary).unionByName(good)


def normalize_events(arrivals: DataFrame, limits: HotKeys = HotKeys(), unusable: bool = False) -> DataFrame:
    """Usable events of consistent attempts, in canonical form (not yet ordered).

    An attempt is left out as a whole if any of its events names another one, as in ``rejected_events``. With
    ``unusable`` the events that cannot be scored stay, marked by the column ``usable``: they count as arrivals.
    """
    checked = _checked(arrivals)
    if "event_attempt_id" in arrivals.columns:
        checked = _consistent(checked, limits)
    usable = _lifted(checked if unusable else checked.where("usable"))
    seq = F.expr("try_cast(try_cast(client_seq AS DOUBLE) AS BIGINT)")
    return (
        usable.where(F.length("attempt_id") > 0)
        .withColumn("client_seq", F.coalesce(seq, F.lit(0)) if "client_seq" in arrivals.columns else F.lit(0))
        .drop("mismatch", "event_attempt_id", *([] if unusable else ["usable"]))
    )


def ordered_events(events: DataFrame, limits: HotKeys = HotKeys()) -> DataFrame:
    """Position of every event in its attempt: time, then client sequence, then arrival."""
    return on_timelines(
        events,
        lambda t: t.scan(Scan("event_rn", "sum", F.lit(1).cast("long"), here=True)).rows,
        limits=limits,
        order=ORDER,
    )


def _is(event_type: str, column: str | None = None, value: str | None = None) -> Column:
    test = F.col("event_type") == event_type
    if column:
        test = test & (F.col(column) == value)
    return F.coalesce(test, F.lit(False))


def event_flags(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "is_paste": _is("clipboard", "action", "paste"),
            "is_tab_hidden": _is("visibility_change", "state", "hidden"),
            "is_tab_visible": _is("visibility_change", "state", "visible"),
            "is_idle_start": _is("idle_state", "state", "idle"),
            "is_idle_end": _is("idle_state", "state", "active"),
            "is_question_enter": _is("question_view", "action", "enter"),
            "is_question_leave": _is("question_view", "action", "leave"),
            "is_answer": _is("question_answer"),
            "is_submit": _is("exam_submitted"),
        }
    )
