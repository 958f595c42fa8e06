"""As-of lookups and the relational steps around scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HotKeys
from vigilframe.functions.scalar import safe_label
from vigilframe.operators.normalize import event_flags
from vigilframe.operators.timeline import ORDER, Scan, Timeline, on_timelines

SECOND = 1_000_000


def asof_event(
    events: DataFrame,
    probe: Column,
    target: Column,
    within_s: float,
    direction: str = "last",
    by: tuple[str, ...] = (),
    limits: HotKeys = HotKeys(),
) -> DataFrame:
    """For every probe event the last target before it (or the next after it), if near enough."""

    def step(t: Timeline) -> DataFrame:
        found = t.map(event_flags).scan(
            Scan("match_us", direction, F.when(target, F.col("t_us"))),
            Scan("match_arrival", direction, F.when(target, F.col("arrival"))),
            by=by,
        )
        gap = F.abs(F.col("t_us") - F.col("match_us"))
        return (
            found.rows.where(probe)
            .withColumn("gap_s", gap / SECOND)
            .where(gap <= int(within_s * SECOND))
            .select("attempt_id", "arrival", "question_id", "match_arrival", "gap_s")
        )

    return on_timelines(events, step, limits=limits)


def paste_attribution(
    events: DataFrame,
    change: Column,
    paste_size: Column,
    within_ms: int = 2000,
    limits: HotKeys = HotKeys(),
) -> DataFrame:
    """Answer changes with the paste they most likely came from (same question)."""

    def step(t: Timeline) -> DataFrame:
        seen = t.map(event_flags).scan(
            Scan("_paste_us", "last", F.when(F.col("is_paste"), F.col("t_us"))),
            Scan("paste_size", "last", F.when(F.col("is_paste"), paste_size)),
            by=("question_id",),
        )
        ms = F.floor((F.col("t_us") - F.col("_paste_us")) / 1000)
        return (
            seen.rows.where(change & (F.length("question_id") > 0))
            .withColumn("paste_recent_ms", ms)
            .withColumn("change_type", F.when(ms.between(0, within_ms), "paste").otherwise("input"))
            .select("attempt_id", "arrival", "question_id", "change_type", "paste_recent_ms", "paste_size")
        )

    return on_timelines(events, step, limits=limits)


def prefix_stats(events: DataFrame, order: tuple[str, ...] = ("arrival",), limits: HotKeys = HotKeys()) -> DataFrame:
    """What a re-score at each arrival has before it: size, span and counts of the prefix.

    Joining every event with all earlier ones would say the same; running aggregates give the
    numbers with one row per event.
    """
    one = lambda flag: F.col(flag).cast("long")

    def step(t: Timeline) -> DataFrame:
        return (
            t.map(event_flags)
            .scan(
                Scan("prefix_events", "sum", F.lit(1).cast("long"), here=True),
                Scan("prefix_first_us", "min", F.col("t_us"), here=True),
                Scan("prefix_last_us", "max", F.col("t_us"), here=True),
                Scan("prefix_pastes", "sum", one("is_paste"), here=True),
                Scan("prefix_hidden", "sum", one("is_tab_hidden"), here=True),
                order=order,
            )
            .rows.select(
                "attempt_id",
                "arrival",
                "prefix_events",
                "prefix_first_us",
                "prefix_last_us",
                "prefix_pastes",
                "prefix_hidden",
            )
        )

    return on_timelines(events, step, limits=limits, order=order)


def touched_attempts(events: DataFrame, batch: DataFrame, limits: HotKeys = HotKeys()) -> DataFrame:
    """All stored events of the attempts that occur in the batch."""
    ids = batch.select("attempt_id").distinct()
    if ids.count() <= limits.broadcast_rows:
        ids = F.broadcast(ids)
    return events.join(ids, "attempt_id", "left_semi")


def expected_predicted(labels: DataFrame, results: DataFrame) -> DataFrame:
    """Label and prediction of each attempt, both made safe."""
    return labels.where(F.length("attempt_id") > 0).join(results, "attempt_id").withColumns(
        {
            "expected_label": safe_label(F.col("expected_label")),
            "predicted_label": safe_label(F.col("risk")),
        }
    )


def first_known(rows: DataFrame, columns: tuple[str, ...], order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first row of each attempt (by order), as it is."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy("attempt_id").agg(first.alias("_f")).select("attempt_id", "_f.*")


def report_identity(attempts: DataFrame, events: DataFrame, history: DataFrame) -> DataFrame:
    """Name, mail and assessment: from the attempt, else its first event, else its first history row."""
    names = ("candidate_name", "candidate_email", "assessment_name")
    # Report fallbacks.
    fallback = {
        "candidate_name": "Unknown Candidate",
        "candidate_email": "No email available",
        "assessment_name": "Assessment",
    }

    def side(rows: DataFrame, prefix: str, order: tuple[str, ...]) -> DataFrame:
        first = first_known(rows, names, order)
        return first.select("attempt_id", *[F.col(n).alias(prefix + n) for n in names])

    joined = (
        attempts.select("attempt_id", *names)
        .join(side(events, "e_", ORDER), "attempt_id", "left")
        .join(side(history, "h_", ("timestamp_us", "arrival")), "attempt_id", "left")
    )
    empty = F.lit("")
    return joined.select(
        "attempt_id",
        *[
            F.coalesce(
                F.nullif(F.col(n), empty),
                F.nullif(F.col("e_" + n), empty),
                F.nullif(F.col("h_" + n), empty),
                F.lit(fallback[n]),
            ).alias(n)
            for n in names
        ],
    )
