"""Ordered event timelines that survive hot attempts.

Every order-dependent operator of this library is a *scan*: for each event, the last matching
value before it, the next one after it, or a running sum / min / max. A plain window does that
with one exchange on the attempt, but puts the whole attempt into one task.

``timelines`` therefore counts first (one column, partial aggregation). Attempts of ordinary size
keep the plain window. Rows of the few attempts above the limit are range-partitioned on the full
order key, so each slice holds a bounded number of rows whatever the attempt looks like, and
``Timeline.scan`` works per slice and adds what the neighbouring slices carry over (one summary
row per slice).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilframe.config import HotKeys
from vigilframe.session import cut

ORDER = ("t_us", "client_seq", "arrival")
SLICE = "_slice"


@dataclass(frozen=True)
class Scan:
    """One running value. ``how``: last, next, sum, min or max; ``here`` includes the row itself."""

    name: str
    how: str
    value: Column
    here: bool = False

    def local(self, forward, backward) -> Column:
        if self.how == "next":
            return F.last(self.value, ignorenulls=True).over(backward.rowsBetween(W.unboundedPreceding, -1))
        frame = forward.rowsBetween(W.unboundedPreceding, 0 if self.here else -1)
        if self.how == "last":
            return F.last(self.value, ignorenulls=True).over(frame)
        running = getattr(F, self.how)(self.value).over(frame)
        return F.coalesce(running, F.lit(0)) if self.how == "sum" else running

    def of_slice(self, order: Sequence[str]) -> Column:
        at = F.when(self.value.isNotNull(), F.struct(*order))
        if self.how == "last":
            return F.max_by(self.value, at)
        if self.how == "next":
            return F.min_by(self.value, at)
        return getattr(F, self.how)(self.value)

    def carried(self, before, after) -> Column:
        value = F.col(self.name)
        if self.how == "next":
            return F.last(value, ignorenulls=True).over(after)
        if self.how == "last":
            return F.last(value, ignorenulls=True).over(before)
        return getattr(F, self.how)(value).over(before)

    def joined(self, carry: Column) -> Column:
        own = F.col(self.name)
        if self.how in ("last", "next"):
            return F.coalesce(own, carry)
        if self.how == "sum":
            return own + F.coalesce(carry, F.lit(0))
        return {"min": F.least, "max": F.greatest}[self.how](own, carry)


@dataclass(frozen=True)
class Timeline:
    rows: DataFrame
    key: tuple[str, ...] = ("attempt_id",)
    sliced: bool = False
    small: bool = False  # number of attempts is known to be broadcastable

    def map(self, step: Callable[[DataFrame], DataFrame]) -> "Timeline":
        return replace(self, rows=step(self.rows))

    def scan(self, *scans: Scan, by: Sequence[str] = (), order: Sequence[str] = ORDER) -> "Timeline":
        """Add one column per scan, computed over the timeline or over each ``by`` group in it."""
        part = [*self.key, *([SLICE] if self.sliced else []), *by]
        forward = W.partitionBy(*part).orderBy(*order)
        backward = W.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
        rows = self.rows
        for chosen in (
            [s for s in scans if s.how != "next"],
            [s for s in scans if s.how == "next"],
        ):
            if chosen:
                rows = rows.withColumns({s.name: s.local(forward, backward) for s in chosen})
        if not self.sliced:
            return replace(self, rows=rows)

        whole = W.partitionBy(*self.key, *by)
        before = whole.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
        after = whole.orderBy(F.col(SLICE).desc()).rowsBetween(W.unboundedPreceding, -1)
        carry = (
            self.rows.groupBy(*part)
            .agg(*[s.of_slice(order).alias(s.name) for s in scans])
            .select(
                *[F.col(c).alias(f"_c_{c}") for c in part],
                *[s.carried(before, after).alias(f"_in_{s.name}") for s in scans],
            )
        )
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in part])
        rows = (
            rows.join(carry, same, "left")
            .withColumns({s.name: s.joined(F.col(f"_in_{s.name}")) for s in scans})
            .drop(*carry.columns)
        )
        return replace(self, rows=cut(rows))

    def attach(self, per_key: DataFrame, how: str = "inner") -> "Timeline":
        """Join one row per attempt to the events; the rows of hot attempts stay where they are."""
        side = F.broadcast(per_key) if self.sliced and self.small else per_key
        return replace(self, rows=self.rows.join(side, list(self.key), how))


def timelines(
    events: DataFrame,
    key: Sequence[str] = ("attempt_id",),
    limits: HotKeys = HotKeys(),
    order: Sequence[str] = ORDER,
) -> list[Timeline]:
    key = tuple(key)
    if limits.hot_rows is None:
        return [Timeline(events, key)]
    sizes = events.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > limits.hot_rows)
    totals = sizes.agg(F.count("*").alias("keys"), F.sum("_n").alias("rows")).first()
    if not totals["keys"]:
        return [Timeline(events, key)]
    small = totals["keys"] <= limits.broadcast_rows
    hot = cut(sizes.select(*key))
    side = F.broadcast(hot) if small else hot
    slices = max(2, -(-totals["rows"] // limits.slice_rows))
    sliced = cut(
        events.join(side, list(key), "left_semi")
        .repartitionByRange(slices, *key, *order)
        .withColumn(SLICE, F.spark_partition_id().cast("long"))
    )
    return [
        Timeline(events.join(side, list(key), "left_anti"), key),
        Timeline(sliced, key, sliced=True, small=small),
    ]


def census(events: DataFrame, limits: HotKeys, key: Sequence[str] = ("attempt_id",)) -> HotKeys:
    """One count of the events for all operators on them: limits without further checks if no attempt is above them.

    Sessions and questions are parts of an attempt, so they need no check of their own then.
    """
    if limits.hot_rows is None:
        return limits
    above = events.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > limits.hot_rows)
    return replace(limits, hot_rows=None) if above.isEmpty() else limits


def on_timelines(
    events: DataFrame,
    step: Callable[[Timeline], DataFrame],
    key: Sequence[str] = ("attempt_id",),
    limits: HotKeys = HotKeys(),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Run ``step`` on the ordinary and, if there are any, on the hot attempts."""
    parts = [step(t).drop(SLICE) for t in timelines(events, key, limits, order)]
    return reduce(DataFrame.unionByName, parts)
