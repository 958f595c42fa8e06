"""Dashboard, queue and report tables over score logs and attempt rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilframe.functions.review import (
    DEFAULT_ASSESSMENT,
    EVENT_LABELS,
    NO_EMAIL,
    UNKNOWN_NAME,
    event_label,
    event_tone,
    exam_status,
    latest_activity,
)
from vigilframe.functions.scalar import filled, format_duration

VIOLATIONS = (*EVENT_LABELS, "question_answer")


def filter_attempt_log(log: DataFrame, risks: Sequence[str] = (), search: str = "", time: str = "timestamp") -> DataFrame:
    """Chosen risks and a literal part of the attempt id in any case, newest first."""
    rows = log
    if risks:
        rows = rows.where(F.col("risk").isin(*risks))
    if search:
        rows = rows.where(F.lower("attempt_id").contains(search.lower()))
    return rows.orderBy(F.col(time).desc(), "attempt_id")


def search_attempts(attempts: DataFrame, risks: Sequence[str], search: str = "") -> DataFrame:
    """Chosen risks (none counts as LOW) and a part of id, name or mail in any case."""
    text = F.concat_ws(
        " ", *[F.coalesce(c, F.lit("")) for c in ("attempt_id", "candidate_name", "candidate_email")]
    )
    return attempts.where(filled(F.col("risk"), "LOW").isin(*risks) & F.lower(text).contains(search.lower()))


def violation_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*VIOLATIONS)).withColumns(
        {
            "label": event_label(F.col("event_type"), F.col("question_id")),
            "tone": event_tone(F.col("event_type")),
        }
    )


def flatten_features(log: DataFrame) -> DataFrame:
    """Features of each log row as columns; what is missing counts 0."""
    f = lambda name, alias=None: F.coalesce(F.col(f"features.{name}"), F.lit(0)).alias(alias or name)
    return log.select(
        "attempt_id",
        "risk",
        f("paste_count"),
        f("tab_hidden_count"),
        f("questions_seen"),
        f("time_per_question_mean_s", "time_per_question"),
        f("attempt_duration_s", "attempt_duration"),
    )


def explode_signals(log: DataFrame) -> DataFrame:
    """One row per attempt and signal; signals are a map of name to (score, components)."""
    return log.select("attempt_id", F.explode("signals").alias("signal", "_v")).select(
        "attempt_id", "signal", F.coalesce("_v.score", F.lit(0.0)).alias("score")
    )


def attempt_drilldown(log: DataFrame, attempt_id: str, time: str = "timestamp") -> DataFrame:
    """Newest log row of one attempt with what the detail view shows; of rows of one time the highest score."""
    number = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    texts = [F.col(c) for c in ("explanation_text", "explanation") if c in log.columns]
    return (
        log.where(F.col("attempt_id") == attempt_id)
        .orderBy(F.col(time).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ("combined_score", "confidence_score", "risk")])
        .limit(1)
        .select(
            "attempt_id",
            "risk",
            number("confidence"),
            number("confidence_score"),
            number("combined_score"),
            filled(*texts, "No explanation available.").alias("explanation"),
            "features.*",
        )
    )


def dashboard_kpis(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("HIGH", "MEDIUM", "LOW")],
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg("combined_score"), F.lit(0.0)).alias("avg_score"),
    )


def console_stats(attempts: DataFrame) -> DataFrame:
    """Totals of the console; needs risk, status and confidence."""
    n = F.count("*")
    return attempts.agg(
        n.alias("total"),
        *[F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("HIGH", "MEDIUM", "LOW")],
        F.count_if(F.col("status") == "ONGOING").alias("ongoing"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed"),
        (F.coalesce(F.sum("confidence"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("avg_confidence"),
    )


def risk_distribution(log: DataFrame) -> DataFrame:
    return log.where("risk IS NOT NULL").groupBy("risk").agg(F.count("*").alias("n"))


def feature_means_by_risk(flat: DataFrame) -> DataFrame:
    """Means per risk over ``flatten_features``."""
    return flat.groupBy("risk").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("paste_count", "tab_hidden_count", "time_per_question")]
    )


def score_trend(log: DataFrame, time: str = "timestamp") -> DataFrame:
    return log.where(F.col(time).isNotNull()).select(time, "attempt_id", "combined_score").orderBy(time, "attempt_id")


def risk_options(log: DataFrame) -> DataFrame:
    return log.where("risk IS NOT NULL").select("risk").distinct().orderBy("risk")


def top_alerts(log: DataFrame, n: int = 8, time: str = "timestamp") -> DataFrame:
    """Newest HIGH and MEDIUM rows."""
    return (
        log.where(F.col("risk").isin("HIGH", "MEDIUM"))
        .select("attempt_id", "risk", "combined_score", "confidence", time)
        .orderBy(F.col(time).desc(), "attempt_id")
        .limit(n)
    )


def log_explorer(log: DataFrame, n: int = 200, time: str = "timestamp") -> DataFrame:
    return (
        log.select(time, "attempt_id", "risk", "confidence", "confidence_score", "combined_score")
        .orderBy(F.col(time).desc(), "attempt_id")
        .limit(n)
    )


def attempt_display() -> dict[str, Column]:
    """Names and texts of an attempt row with their fallbacks."""
    return {
        "display_name": filled(F.col("candidate_name"), F.col("attempt_id"), UNKNOWN_NAME),
        "display_email": filled(F.col("candidate_email"), NO_EMAIL),
        "display_assessment": filled(F.col("assessment_name"), DEFAULT_ASSESSMENT),
        "duration_text": format_duration(F.col("attempt_duration_s")),
    }


def review_queue(attempts: DataFrame, n: int = 150, time: str = "timestamp") -> DataFrame:
    """Newest attempts with names, status, last activity, duration and event count."""
    newest = attempts.orderBy(F.col(time).desc(), "attempt_id").limit(n)
    shown = attempt_display()
    return newest.select(
        "attempt_id",
        *[c.alias(name) for name, c in shown.items()],
        exam_status(F.col("has_submit_event"), F.col("latest_event_type")).alias("status"),
        filled(F.col("risk"), "LOW").alias("risk"),
        "combined_score",
        latest_activity(
            F.col("latest_event_type"), F.col("latest_question_id"), F.col("explanation_text")
        ).alias("activity"),
        F.coalesce("latest_event_us", time).alias("last_activity_at"),
        "event_count",
    )


def panel_top(attempts: DataFrame, n: int = 8, time: str = "timestamp") -> DataFrame:
    """Newest n attempts of each panel: ongoing, completed, HIGH and MEDIUM."""
    panels = F.array_compact(
        F.array(
            F.col("status"),
            F.when(F.col("risk").isin("HIGH", "MEDIUM"), F.col("risk")),
        )
    )
    newest = W.partitionBy("panel").orderBy(F.col(time).desc(), "attempt_id")
    return (
        attempts.select("attempt_id", time, F.explode(panels).alias("panel"))
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= n)
    )
