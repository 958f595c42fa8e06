"""Tables and logs written by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.operators.features import FEATURE_COLUMNS
from vigilframe.operators.scoring import signal_items
from vigilframe.schema import ATTEMPT_BUCKET, IDENTITY, attempt_bucket
from vigilframe.sinks.state import StateLog

SPREAD = 4


def append_raw_events(events: DataFrame, path: str, received: str = "received_at", digits: int = 0) -> None:
    """Append raw events, partitioned by the day of receipt and clustered by attempt in each file.

    With ``digits`` the days are partitioned again by that many hexadecimal digits of a hash of the attempt, so that
    ``readers.of_attempt`` opens one folder in 16 ** digits of each day. Bloom filters on the attempt let it skip row
    groups in any layout. An append has SPREAD files in a folder at most, whatever attempt is in it.
    """
    rows, folders = events.withColumn("event_date", F.to_date(F.col(received))), ["event_date"]
    if digits:
        rows, folders = rows.withColumn(ATTEMPT_BUCKET, attempt_bucket(F.col("attempt_id"), digits)), ["event_date", ATTEMPT_BUCKET]
        rows = rows.repartition(*folders, F.pmod(F.xxhash64("attempt_id", "event_type", "occurred_at"), F.lit(SPREAD)))
    (
        rows.sortWithinPartitions(*folders, "attempt_id")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#attempt_id", "true")
        .partitionBy(*folders)
        .parquet(path)
    )


def score_log_rows(results: DataFrame, timestamp: Column) -> DataFrame:
    """Results in the shape of the score log."""
    signals = F.map_from_entries(
        F.transform(signal_items(), lambda s: F.struct(s["name"], F.struct(s["score"], s["components"])))
    )
    return results.select(
        timestamp.cast("string").alias("timestamp"),
        "attempt_id",
        "risk",
        "confidence",
        "confidence_score",
        "combined_score",
        F.struct(*FEATURE_COLUMNS).alias("features"),
        signals.alias("signals"),
    )


def append_score_log(log_rows: DataFrame, path: str) -> None:
    log_rows.write.mode("append").json(path)


def history_rows(progressive: DataFrame, timestamp: Column) -> DataFrame:
    """Per-event results in the shape of the risk history."""
    identity = [c for c in ("arrival", *IDENTITY) if c in progressive.columns]
    return progressive.select(
        "attempt_id",
        *identity,
        "risk",
        F.col("confidence_score").alias("confidence"),
        "combined_score",
        "reason",
        timestamp.alias("timestamp"),
    )


def append_risk_history(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append history rows; with a batch id a repeated batch replaces its own rows."""
    if batch_id is None:
        rows.write.mode("append").parquet(path)
        return
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def current_risk(path: str, updated: str = "updated_at", buckets: int = StateLog.buckets) -> StateLog:
    return StateLog(path, "attempt_id", updated, buckets)


def upsert_current_risk(
    changes: DataFrame,
    path: str,
    version: int,
    updated: str = "updated_at",
    expired_before: Column | None = None,
    buckets: int = StateLog.buckets,
) -> DataFrame:
    """Lay changes over the state of the version before; only the changed rows are written.

    A repeated version overwrites only itself and gives the same result; readers of the version
    before are not disturbed. States last updated before ``expired_before`` are left out, so the
    state holds live attempts only.
    """
    return current_risk(path, updated, buckets).upsert(changes, version, expired_before)


def read_current_risk(spark: SparkSession, path: str, version: int, attempts: DataFrame | None = None) -> DataFrame | None:
    """One version of the state, or of some attempts in it; none if it was never written."""
    return current_risk(path).read(spark, version, attempts)


def carry_current_risk(spark: SparkSession, path: str, version: int) -> None:
    """The state of the version before again, for a version without changes."""
    current_risk(path).carry(spark, version)


def drop_old_states(spark: SparkSession, path: str, before: int) -> None:
    """Remove the versions of the state below ``before``."""
    current_risk(path).drop_old(spark, before)


def live_update_feed(rows: DataFrame, mode: str = "progressive_ingest") -> DataFrame:
    """Key and JSON value of one update message per row; needs the columns of ``progressive_risk``."""
    identity = [c for c in IDENTITY if c in rows.columns]
    message = F.struct(
        F.lit("risk_update").alias("type"),
        F.lit(mode).alias("mode"),
        "attempt_id",
        *identity,
        F.struct("event_type", "payload", "occurred_at").alias("latest_event"),
        "risk",
        F.col("confidence_score").alias("confidence"),
        "combined_score",
        F.col("explanation_text").alias("explanation"),
        "event_count",
        F.struct("risk", "combined_score", "reason", F.col("received_at").cast("string").alias("timestamp")).alias(
            "timeline_point"
        ),
    )
    return rows.select(F.col("attempt_id").alias("key"), F.to_json(message).alias("value"))


def write_training_csv(rows: DataFrame, path: str, label: str, features: Sequence[str]) -> None:
    """Label first, then the features in their order, with a header."""
    rows.select(label, *features).write.mode("overwrite").option("header", True).csv(path)


def write_eval_report(metrics: DataFrame, confusion: DataFrame, path: str) -> None:
    """Metrics as JSON and the confusion matrix with totals as CSV below ``path``."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    confusion.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion")
