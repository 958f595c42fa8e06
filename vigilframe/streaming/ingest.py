"""The progressive ingest job: store events, re-score touched attempts, keep history and live state.

A micro-batch is the unit of atomicity. Everything it writes is keyed by its batch id, so a batch
that is repeated after a failure replaces its own output. Scores go on from what is kept of each open attempt
(``plans.carried``), so a batch costs its own events. Only attempts with an event that comes late are scored from
their stored events, and only the days their open sessions reach back to are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilframe.config import HotKeys, PatternRules, ScoringRules
from vigilframe.functions.scalar import parse_event_time
from vigilframe.operators.history import TTL_S
from vigilframe.operators.normalize import normalize_events, unusable_reason
from vigilframe.operators.timeline import Scan, census, on_timelines
from vigilframe.plans.carried import carried_over, continued, reached_back, sessions
from vigilframe.plans.progressive import progressive_risk
from vigilframe.plans.score import Predict
from vigilframe.schema import IDENTITY
from vigilframe.session import cut
from vigilframe.sinks.state import StateLog
from vigilframe.sinks.writers import (
    append_risk_history,
    carry_current_risk,
    drop_old_states,
    history_rows,
    live_update_feed,
    read_current_risk,
    score_log_rows,
    upsert_current_risk,
)
from vigilframe.sources.streams import UNREADABLE

KEPT_STATES = 3  # versions of the live state that readers and a repeated batch may still need
BATCH_SPAN = 2**31  # more than the events one attempt can have in one batch


@dataclass(frozen=True)
class IngestPaths:
    """Where the job keeps its tables; all on storage that every executor reaches.

    ``buckets`` is for the states by attempt (see ``StateLog``).
    """

    root: str
    buckets: int = StateLog.buckets

    @property
    def events(self) -> str:
        return f"{self.root}/raw_events"

    @property
    def history(self) -> str:
        return f"{self.root}/risk_history"

    @property
    def state(self) -> str:
        return f"{self.root}/current_risk"

    @property
    def kept(self) -> StateLog:
        return StateLog(f"{self.root}/kept", "attempt_id", "last_received_us", self.buckets)

    @property
    def feed(self) -> str:
        return f"{self.root}/live_updates"

    @property
    def log(self) -> str:
        return f"{self.root}/score_log"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/_stream"


def _write_batch(rows: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Rows of a batch; texts are compressed, as messages repeat names and phrases in every row."""
    writer = rows.write.mode("overwrite").format(fmt)
    if fmt == "json":
        writer = writer.option("compression", "gzip")
    writer.save(f"{path}/batch_id={batch_id}")


PLACE = ("_event_us", "_position")


def _placed(batch: DataFrame) -> DataFrame:
    """A micro-batch with the place of its rows, written down: the source is read and parsed once."""
    at = F.coalesce(F.unix_micros(parse_event_time(F.col("occurred_at"))), F.lit(2**62))
    return cut(batch.withColumns({"_event_us": at, "_position": F.monotonically_increasing_id()}))


def _arrivals(placed: DataFrame, batch_id: int, limits: HotKeys) -> DataFrame:
    """Number the events of each attempt by arrival, after those of all earlier batches.

    A micro-batch is received at one instant, so inside it events count as arriving in event time, those
    without a readable time last.
    """
    ranked = on_timelines(
        placed,
        lambda t: t.scan(Scan("_rank", "sum", F.lit(1).cast("long"), here=True), order=PLACE).rows,
        limits=limits,
        order=PLACE,
    )
    return ranked.withColumn("arrival", F.col("_rank") + F.lit(batch_id * BATCH_SPAN)).drop("_rank", *PLACE)


def quarantined(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch that cannot be scored, with the reason."""
    reason = unusable_reason()
    if UNREADABLE in batch.columns:
        reason = F.when(F.col(UNREADABLE).isNotNull(), "Unreadable record").otherwise(reason)
    return batch.withColumn("reason", reason).where("reason IS NOT NULL")


def score_batch(
    batch: DataFrame,
    batch_id: int,
    paths: IngestPaths,
    scoring: ScoringRules = ScoringRules(),
    patterns: PatternRules = PatternRules(),
    ttl_s: float | None = TTL_S,
    limits: HotKeys = HotKeys(),
    predict: Predict | None = None,
) -> None:
    """Store one micro-batch and write what follows from it.

    Every row with an attempt is stored, counts as an event and gets a history, feed and log row once its
    attempt has a score; rows that cannot be scored are kept in the quarantine table as well, those
    without an attempt only there.
    """
    spark = batch.sparkSession
    batch = _placed(batch)
    _write_batch(quarantined(batch.drop(*PLACE)), paths.quarantine, batch_id)
    named = batch.where(F.length("attempt_id") > 0).drop(UNREADABLE)
    fresh = _arrivals(named, batch_id, limits).withColumns(
        {"event_date": F.to_date("received_at"), "batch_id": F.lit(batch_id).cast("long")}
    )
    (
        fresh.sortWithinPartitions("event_date", "attempt_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "batch_id")
        .parquet(paths.events)
    )
    span = fresh.agg(
        F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.max("received_at").alias("newest")
    ).first()
    if span["first"] is None:
        carry_current_risk(spark, paths.state, batch_id)
        paths.kept.carry(spark, batch_id)
        return
    keep = (*IDENTITY, "event_type", "payload", "occurred_at", "received_at", "session_start_us")
    with_us = lambda rows: rows.withColumn("received_us", F.unix_micros("received_at"))
    log = paths.kept
    kept = log.read(spark, batch_id - 1, fresh)
    of_batch = census(fresh, limits)
    rows = cut(sessions(normalize_events(with_us(fresh), limits, unusable=True), kept, ttl_s, of_batch))
    late = None
    if kept is not None:
        late = cut(reached_back(rows))
    n_late = late.count() if kept is not None else 0
    small = F.broadcast(late) if 0 < n_late <= limits.broadcast_rows else late
    on_time = rows.join(small, "attempt_id", "left_anti") if n_late else rows
    scored, keeping = continued(on_time, scoring, patterns, keep, of_batch, predict, cut)
    if n_late:
        first = _first_day(late, span["first"], paths, batch_id, ttl_s)
        raw = read_events(spark, paths, first, span["last"]).where(F.col("batch_id") <= batch_id)
        events = cut(normalize_events(with_us(raw.join(small, "attempt_id", "left_semi")), limits, unusable=True))
        again = progressive_risk(
            events,
            scoring,
            patterns,
            ttl_s,
            passthrough=keep,
            after_arrival=batch_id * BATCH_SPAN,
            instant="batch_id",
            limits=limits,
            predict=predict,
        )
        scored = scored.unionByName(again, allowMissingColumns=True)
        keeping = keeping.unionByName(carried_over(events, ttl_s, patterns, limits))
    scored = cut(scored)

    append_risk_history(history_rows(scored, F.col("received_at")), paths.history, batch_id)
    _write_batch(live_update_feed(scored), paths.feed, batch_id, "json")
    _write_batch(score_log_rows(scored, F.col("received_at")), paths.log, batch_id, "json")

    state = ("risk", "confidence_score", "combined_score", "explanation_text", "event_count", "session_start_us")
    latest = scored.groupBy("attempt_id").agg(
        F.max_by(F.struct(*IDENTITY, *state, F.col("received_at").alias("updated_at")), "arrival").alias("_s")
    )
    changes = (
        latest.select("attempt_id", "_s.*")
        .withColumnRenamed("confidence_score", "confidence")
        .withColumnRenamed("explanation_text", "explanation")
    )
    expired = None
    if ttl_s is not None:
        expired = F.lit(span["newest"]) - F.expr(f"INTERVAL {int(ttl_s)} SECONDS")
    upsert_current_risk(changes, paths.state, batch_id, expired_before=expired, buckets=paths.buckets)
    log.upsert(keeping, batch_id, None if expired is None else F.unix_micros(expired))
    drop_old_states(spark, paths.state, batch_id - KEPT_STATES)
    log.drop_old(spark, batch_id - KEPT_STATES)


def read_events(spark: SparkSession, paths: IngestPaths, first: date | None = None, last: date | None = None) -> DataFrame:
    """Stored events; with both days given, only the folders of those days are listed."""
    reader = spark.read.option("basePath", paths.events)
    if first is None or last is None:
        return reader.parquet(paths.events)
    days = [str(first + timedelta(days=n)) for n in range((last - first).days + 1)]
    return reader.parquet(f"{paths.events}/event_date={{{','.join(days)}}}")


def _first_day(
    attempts: DataFrame, today: date, paths: IngestPaths, batch_id: int, ttl_s: float | None
) -> date | None:
    """First day that an open session of the attempts has events on; none means all days."""
    if ttl_s is None:
        return None
    kept = paths.kept.read(attempts.sparkSession, batch_id - 1, attempts)
    open_since = kept.agg(F.to_date(F.timestamp_micros(F.min("session_start_us"))).alias("day")).first()["day"]
    return min(today, open_since) if open_since else today


def stream_score_attempts(
    events: DataFrame,
    paths: IngestPaths,
    scoring: ScoringRules = ScoringRules(),
    patterns: PatternRules = PatternRules(),
    ttl_s: float | None = TTL_S,
    limits: HotKeys = HotKeys(),
    predict: Predict | None = None,
    **trigger,
) -> StreamingQuery:
    """Start the job on a stream of ingest events stamped with ``received_at``."""
    return (
        events.writeStream.foreachBatch(
            lambda batch, batch_id: score_batch(batch, batch_id, paths, scoring, patterns, ttl_s, limits, predict)
        )
        .option("checkpointLocation", paths.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_attempt_state(events: DataFrame, late_s: float, ttl_s: float = TTL_S) -> DataFrame:
    """Order-free state per attempt session, kept by Spark until the TTL has passed without events.

    Receipt times more than ``late_s`` behind the newest one of any attempt no longer count, so in a replay
    it has to cover the whole disorder of the replayed receipts; ``late_receipts`` finds what fell behind.
    """
    action, state = (F.get_json_object("payload", f"$.{k}") for k in ("action", "state"))
    paste = (F.col("event_type") == "clipboard") & (action == "paste")
    hidden = (F.col("event_type") == "visibility_change") & (state == "hidden")
    at = parse_event_time(F.col("occurred_at"))
    return (
        events.where(F.length("attempt_id") > 0)
        .withWatermark("received_at", f"{int(late_s)} seconds")
        .groupBy("attempt_id", F.session_window("received_at", f"{int(ttl_s)} seconds").alias("session"))
        .agg(
            F.count("*").alias("event_count"),
            F.count_if(paste).alias("paste_count"),
            F.count_if(hidden).alias("tab_hidden_count"),
            F.count_if(F.col("event_type") == "exam_submitted").alias("submits"),
            F.min(at).alias("first_event_at"),
            F.max(at).alias("last_event_at"),
        )
    )


def late_receipts(batch: DataFrame, newest_before, late_s: float) -> DataFrame:
    """Rows of a micro-batch whose receipt lies behind the watermark that ``newest_before`` gives."""
    return batch.where(F.col("received_at") < F.lit(newest_before) - F.expr(f"INTERVAL {int(late_s)} SECONDS"))


def late_events(
    events: DataFrame, late_s: float, limits: HotKeys = HotKeys(), marks: DataFrame | None = None
) -> DataFrame:
    """Events that arrive more than ``late_s`` after a newer event of their attempt (none is dropped).

    ``marks`` holds the newest time (``newest_us``) that each attempt had before these events.
    """
    newest, extra = F.col("_newest"), []
    if marks is not None:
        events = events.join(marks.select("attempt_id", F.col("newest_us").alias("_mark")), "attempt_id", "left")
        newest, extra = F.greatest("_newest", "_mark"), ["_mark"]
    behind: Column = newest - F.col("t_us")
    return on_timelines(
        events,
        lambda t: t.scan(Scan("_newest", "max", F.col("t_us")), order=("arrival",))
        .rows.where(behind > int(late_s * 1_000_000))
        .withColumn("late_by_s", behind / 1_000_000)
        .drop("_newest", *extra),
        limits=limits,
        order=("arrival",),
    )


def late_batch(
    batch: DataFrame, batch_id: int, root: str, late_s: float, limits: HotKeys = HotKeys(), keep_s: float | None = None
) -> None:
    """Write the late events of a micro-batch to ``late`` and the newest time of its attempts to ``marks``.

    The marks are a state log: only those of the batch's attempts are read, and only changed ones are written. With
    ``keep_s``, marks that lie further behind the newest time of all are given up; without, late events are
    found however long their attempt was silent.
    """
    spark, log = batch.sparkSession, StateLog(f"{root}/marks", "attempt_id", "newest_us")
    events = cut(batch.where("t_us IS NOT NULL AND length(attempt_id) > 0"))
    marks = log.read(spark, batch_id - 1, events)
    _write_batch(late_events(events, late_s, limits, marks), f"{root}/late", batch_id)
    tops = events.groupBy("attempt_id").agg(F.max("t_us").alias("newest_us"))
    expired = None
    if keep_s is not None:
        newest = events.agg(F.max("t_us")).first()[0]
        expired = None if newest is None else F.lit(newest - int(keep_s * 1_000_000))
    log.upsert(tops, batch_id, expired)
    log.drop_old(spark, batch_id - KEPT_STATES)


def stream_late_events(
    events: DataFrame,
    root: str,
    late_s: float,
    limits: HotKeys = HotKeys(),
    keep_s: float | None = None,
    **trigger,
) -> StreamingQuery:
    """The late events of a stream of canonical events, also of those whose newer event came in an earlier batch.

    Inside a batch events arrive in the order of ``arrival``. What the job writes is keyed by batch, so that a batch
    that is repeated replaces its own rows.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: late_batch(batch, batch_id, root, late_s, limits, keep_s))
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
