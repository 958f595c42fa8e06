"""Row histories: latest state, transitions, sessions by arrival, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilframe.config import HotKeys
from vigilframe.operators.timeline import ORDER, Scan, Timeline, on_timelines

TTL_S = 21_600


def latest_per_attempt(rows: DataFrame, time: str, arrival: str, limits: HotKeys = HotKeys()) -> DataFrame:
    """Newest row of each attempt laid over the earlier ones, oldest attempt first.

    Rows are taken in arrival order; one that is older than what is already there is ignored. A
    column that the newer row lacks (null) keeps the earlier value.
    """
    at = F.coalesce(F.col(time).cast("double"), F.lit(0.0))
    kept = [c for c in rows.columns if c not in ("attempt_id", arrival)]

    def step(t: Timeline) -> DataFrame:
        taken = t.scan(Scan("_newest", "max", at), order=(arrival,)).rows.where(
            F.col("_newest").isNull() | (at >= F.col("_newest"))
        )
        return taken.groupBy("attempt_id").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in kept]
        )

    known = rows.where(F.length("attempt_id") > 0)
    return on_timelines(known, step, limits=limits, order=(arrival,)).orderBy(time, "attempt_id")


def risk_transitions(history: DataFrame, order: Sequence[str], limits: HotKeys = HotKeys()) -> DataFrame:
    """History rows whose risk differs from the one before."""
    return on_timelines(
        history,
        lambda t: t.scan(Scan("previous_risk", "last", F.col("risk")), order=order).rows.where(
            "previous_risk <> risk"
        ),
        limits=limits,
        order=order,
    )


def cache_sessions(
    events: DataFrame,
    ttl_s: float | None = TTL_S,
    received: str = "received_us",
    limits: HotKeys = HotKeys(),
) -> DataFrame:
    """Number the stretches of an attempt in which no two arrivals are more than the TTL apart."""
    none = F.lit(None).cast("long")
    if ttl_s is None:
        return events.withColumns({"session_id": F.lit(0).cast("long"), "session_start_us": none})
    order = (received, "arrival")
    gap = F.col(received) - F.col("_previous")
    expired = gap > int(ttl_s * 1_000_000)
    first = F.col("_previous").isNull() | expired
    return on_timelines(
        events,
        lambda t: t.scan(Scan("_previous", "last", F.col(received)), order=order)
        .scan(
            Scan("session_id", "sum", F.when(expired, 1).otherwise(0).cast("long"), here=True),
            Scan("session_start_us", "last", F.when(first, F.col(received)), here=True),
            order=order,
        )
        .rows.drop("_previous"),
        limits=limits,
        order=order,
    )


def retain_newest(rows: DataFrame, n: int, *newest: Column) -> DataFrame:
    """The n newest rows of all."""
    return rows.orderBy(*newest).limit(n)


def retain_newest_per_attempt(events: DataFrame, n: int = 5000, limits: HotKeys = HotKeys()) -> DataFrame:
    """The newest n events of every attempt; n is kept between 100 and 50000."""
    n = max(100, min(50_000, n))
    return newest_per_attempt(events, n, limits)


def newest_per_attempt(events: DataFrame, n: int, limits: HotKeys = HotKeys()) -> DataFrame:
    def step(t: Timeline) -> DataFrame:
        if not t.sliced:
            newest = W.partitionBy("attempt_id").orderBy(*[F.col(c).desc() for c in ORDER])
            return t.rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
        totals = t.rows.groupBy("attempt_id").agg(F.count("*").alias("_all"))
        ranked = t.scan(Scan("_rank", "sum", F.lit(1).cast("long"), here=True), order=ORDER).attach(totals)
        return ranked.rows.where(F.col("_rank") > F.col("_all") - n).drop("_rank", "_all")

    return on_timelines(events, step, limits=limits)


def live_risk(current: DataFrame, now_us: Column | int, ttl_s: float = TTL_S) -> DataFrame:
    """Latest state per attempt that has not expired at ``now_us``."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    kept = [c for c in current.columns if c != "attempt_id"]
    latest = current.groupBy("attempt_id").agg(F.max_by(F.struct(*kept), F.col("updated_us")).alias("_s"))
    return latest.select("attempt_id", "_s.*").where(now - F.col("updated_us") <= int(ttl_s * 1_000_000))
