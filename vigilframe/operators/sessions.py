"""Sessions that the browser side derives: idle, typing and focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import HotKeys
from vigilframe.operators.normalize import event_flags
from vigilframe.operators.timeline import Scan, Timeline, on_timelines

SECOND = 1_000_000


def idle_sessions(events: DataFrame, timeout_s: float = 30.0, limits: HotKeys = HotKeys()) -> DataFrame:
    """An idle and an active row for every pause of at least the timeout (5 s to 10 min)."""
    timeout = int(max(5.0, min(600.0, timeout_s)) * SECOND)

    def step(t: Timeline) -> DataFrame:
        pause = F.col("t_us") - F.col("_previous")
        row = lambda state, at, seconds: F.struct(
            F.lit(state).alias("state"), at.alias("t_us"), seconds.alias("duration_s")
        )
        pair = F.array(
            row("idle", F.col("_previous"), pause / SECOND),
            row("active", F.col("t_us"), F.lit(None).cast("double")),
        )
        return (
            t.scan(Scan("_previous", "last", F.col("t_us")))
            .rows.where(pause >= timeout)
            .select("attempt_id", "arrival", F.explode(pair).alias("_r"))
            .select("attempt_id", "arrival", "_r.*")
        )

    return on_timelines(events, step, limits=limits)


def typing_sessions(
    events: DataFrame, change: Column, stop_s: float = 1.5, limits: HotKeys = HotKeys()
) -> DataFrame:
    """Runs of answer changes per question; a run ends the stop gap (0.35 to 8 s) after its last change."""
    stop = int(max(0.35, min(8.0, stop_s)) * SECOND)
    changes = events.where(change & (F.length("question_id") > 0))

    def step(t: Timeline) -> DataFrame:
        pause = F.col("t_us") - F.col("_previous")
        begins = F.when(pause <= stop, 0).otherwise(1).cast("long")
        return (
            t.scan(Scan("_previous", "last", F.col("t_us")), by=("question_id",))
            .scan(Scan("session", "sum", begins, here=True), by=("question_id",))
            .rows.groupBy("attempt_id", "question_id", "session")
            .agg(
                F.min("t_us").alias("start_us"),
                (F.max("t_us") + stop).alias("stop_us"),
                F.count("*").alias("keystrokes"),
            )
            .withColumn("duration_s", (F.col("stop_us") - F.col("start_us")) / SECOND)
        )

    return on_timelines(changes, step, limits=limits)


def focus_sessions(events: DataFrame, limits: HotKeys = HotKeys()) -> DataFrame:
    """Closed intervals away from the page: hidden until visible, blurred until focused."""
    focus = F.col("event_type").isin("focus", "blur")
    tab = F.col("is_tab_hidden") | F.col("is_tab_visible")

    def step(t: Timeline) -> DataFrame:
        seen = t.map(event_flags).scan(
            Scan("_tab", "last", F.when(tab, F.col("state"))),
            Scan("_tab_us", "last", F.when(tab, F.col("t_us"))),
            Scan("_focus", "last", F.when(focus, F.col("event_type"))),
            Scan("_focus_us", "last", F.when(focus, F.col("t_us"))),
        )
        shown = F.col("is_tab_visible") & (F.col("_tab") == "hidden")
        focused = (F.col("event_type") == "focus") & (F.col("_focus") == "blur")
        start = F.when(shown, F.col("_tab_us")).otherwise(F.col("_focus_us"))
        return (
            seen.rows.where(F.coalesce(shown | focused, F.lit(False)))
            .select(
                "attempt_id",
                "arrival",
                F.when(shown, "hidden").otherwise("blurred").alias("kind"),
                start.alias("start_us"),
                F.col("t_us").alias("end_us"),
            )
            .withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / SECOND)
        )

    return on_timelines(events, step, limits=limits)
