"""Sessions of attempts as a stateful stream: closed by the clock, and nothing gets lost on the way.

Spark drops what lies behind the watermark before a stateful operator sees it. So every event comes twice: as a tick,
which moves the watermark and goes no further, and as the event itself, whose watermark column is null and which
always arrives. The operator compares receipts with the watermark itself and hands late ones on as rows of
their own kind. Attempts share a state by hash, as a call of the operator costs far more than the few events of an
attempt; a state holds the open sessions of its attempts; a timer on the watermark closes them, gives
their rows and frees the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilframe.functions.scalar import parse_event_time
from vigilframe.operators.history import TTL_S

COUNTS = ("event_count", "paste_count", "tab_hidden_count", "submits")
FIELDS = ("start_us", "end_us", *COUNTS, "first_us", "last_us")
RAW = ("event_type", "payload", "occurred_at")
OUT = (
    "kind string, attempt_id string, start_us long, end_us long, event_count long, paste_count long, "
    "tab_hidden_count long, submits long, first_us long, last_us long, event_type string, payload string, "
    "occurred_at string, received_us long"
)
NAMES = [c.split()[0] for c in OUT.split(", ")]
SECOND = 1_000_000
#: States that the attempts share: some hundred attempts in each at two million open ones.
BUCKETS = 2**12


def joined(sessions: list[dict], ttl_us: int) -> list[dict]:
    """Sessions whose ends are at most the TTL apart are one."""
    out: list[dict] = []
    for s in sorted(sessions, key=lambda s: s["start_us"]):
        if out and s["start_us"] - out[-1]["end_us"] <= ttl_us:
            last = out[-1]
            last["end_us"] = max(last["end_us"], s["end_us"])
            for c in COUNTS:
                last[c] += s[c]
            times = [t for t in (last["first_us"], s["first_us"]) if t is not None]
            last["first_us"] = min(times, default=None)
            times = [t for t in (last["last_us"], s["last_us"]) if t is not None]
            last["last_us"] = max(times, default=None)
        else:
            out.append(dict(s))
    return out


def by_attempt(rows: pd.DataFrame, ttl_us: int) -> dict[str, list[dict]]:
    """The sessions of a batch's events by attempt."""
    if rows.empty:
        return {}
    code, attempts = pd.factorize(rows["attempt_id"])
    received = rows["received_us"].to_numpy()
    order = np.lexsort((received, code))
    code, received = code[order], received[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = (code[1:] != code[:-1]) | (received[1:] - received[:-1] > ttl_us)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(order)) - 1
    total = lambda c: np.add.reduceat(rows[c].to_numpy()[order].astype("int64"), first).tolist()
    at = rows["event_us"].to_numpy(dtype="float64", na_value=np.nan)[order]
    whole = lambda values: [None if v != v else int(v) for v in values.tolist()]
    columns = {
        "start_us": received[first].tolist(),
        "end_us": received[last].tolist(),
        "event_count": (last - first + 1).tolist(),
        "paste_count": total("is_paste"),
        "tab_hidden_count": total("is_hidden"),
        "submits": total("is_submit"),
        "first_us": whole(np.fmin.reduceat(at, first)),
        "last_us": whole(np.fmax.reduceat(at, first)),
    }
    found: dict[str, list[dict]] = {}
    for attempt, *values in zip(attempts[code[first]], *columns.values()):
        found.setdefault(attempt, []).append(dict(zip(columns, values)))
    return found


def of_events(rows: pd.DataFrame, ttl_us: int) -> list[dict]:
    """The sessions of a batch's events of one attempt."""
    return by_attempt(rows.assign(attempt_id=""), ttl_us).get("", [])


def attempt_sessions(events: DataFrame, late_s: float, ttl_s: float = TTL_S, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two kinds from a stream of ingest events, in append mode.

    ``session``: counts of a stretch of an attempt in which no two receipts are more than the TTL apart, once the
    watermark (``late_s`` behind the newest receipt of all) has passed its end by the TTL. ``late``: an event that was
    received behind the watermark, as it came. Rows without an attempt only move the clock. Attempts share ``buckets``
    states by hash; the number is fixed with the first batch of a checkpoint.
    """
    ttl_us = int(ttl_s * SECOND)
    action, state_ = (F.get_json_object("payload", f"$.{k}") for k in ("action", "state"))
    known = lambda c: F.coalesce(c, F.lit(False))
    rows = events.select(
        F.coalesce("attempt_id", F.lit("")).alias("attempt_id"),
        F.to_json(F.struct(*RAW)).alias("raw"),
        "received_at",
        F.unix_micros("received_at").alias("received_us"),
        known((F.col("event_type") == "clipboard") & (action == "paste")).alias("is_paste"),
        known((F.col("event_type") == "visibility_change") & (state_ == "hidden")).alias("is_hidden"),
        known(F.col("event_type") == "exam_submitted").alias("is_submit"),
        F.unix_micros(parse_event_time(F.col("occurred_at"))).cast("double").alias("event_us"),
    ).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("tick"))
    rows = rows.where("tick OR attempt_id <> ''").select(
        F.pmod(F.xxhash64("attempt_id"), F.lit(buckets)).cast("int").alias("bucket"),
        *["attempt_id", "raw", "received_us", "is_paste", "is_hidden", "is_submit", "event_us"],
        F.when(F.col("tick"), F.col("received_at")).alias("clock"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark_us = state.getCurrentWatermarkMs() * 1000
        held = {}
        if state.exists:
            held = {a: [dict(zip(FIELDS, s)) for s in sessions] for a, sessions in json.loads(state.get[0]).items()}
        out = []
        if not state.hasTimedOut:
            for frame in frames:
                behind = frame["received_us"] <= watermark_us
                late = frame[behind]
                for attempt, raw, received in zip(late["attempt_id"], late["raw"], late["received_us"]):
                    out.append({"kind": "late", "attempt_id": attempt, **json.loads(raw), "received_us": received})
                for attempt, sessions in by_attempt(frame[~behind], ttl_us).items():
                    held[attempt] = joined(held.get(attempt, []) + sessions, ttl_us)
        left, ends = {}, []
        for attempt, sessions in held.items():
            for s in sessions:
                if s["end_us"] + ttl_us < watermark_us:
                    out.append({"kind": "session", "attempt_id": attempt, **s})
                else:
                    left.setdefault(attempt, []).append([s[c] for c in FIELDS])
                    ends.append(s["end_us"])
        if left:
            state.update((json.dumps(left),))
            first = min(ends) + ttl_us
            state.setTimeoutTimestamp(max(first // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=NAMES)
            whole = [c for c in NAMES if c.endswith(("_us", "_count")) or c == "submits"]
            yield frame.astype({c: "Int64" for c in whole})

    return (
        rows.withWatermark("clock", f"{int(late_s)} seconds")
        .where("clock IS NULL")
        .groupBy("bucket")
        .applyInPandasWithState(step, OUT, "sessions string", "append", GroupStateTimeout.EventTimeTimeout)
    )
