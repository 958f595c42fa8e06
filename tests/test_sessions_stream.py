"""Sessions in append mode: closed and freed by the clock, late rows given as such."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilframe.session import fresh_path
from vigilframe.streaming.sessions import attempt_sessions, joined, of_events

SCHEMA = "attempt_id string, event_type string, payload string, occurred_at string, received_at timestamp"
NOON = datetime(2024, 1, 1, 12)


def row(attempt, minute, kind="blur", payload="{}"):
    at = NOON + timedelta(minutes=minute)
    return attempt, kind, payload, at.isoformat() + "Z", at


def run(spark, batches, late_s, ttl_s):
    source, target, state = (fresh_path(spark, f"t_sessions_{n}") for n in ("in", "out", "state"))
    progress = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = (attempt_sessions(stream, late_s, ttl_s).writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        progress.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress][-1])
    return spark.read.parquet(target).collect(), progress


def test_sessions_close_and_late_rows_stay(spark):
    paste, hidden = '{"action": "paste"}', '{"state": "hidden"}'
    batches = [
        [row("a", 0), row("a", 5, "clipboard", paste), row("b", 3, "visibility_change", hidden)],
        [row("a", 12, "exam_submitted"), row("a", 8), row("b", 200), row(None, 50)],  # a gap closes b's first session
        [row("a", 20), row("a", 30, "clipboard", paste), row("c", 199)],  # far behind, c is in time
        [row(None, 1000)],
    ]
    found, left = run(spark, batches, late_s=600, ttl_s=1800)
    sessions = sorted((r.attempt_id, r.event_count, r.paste_count, r.tab_hidden_count, r.submits) for r in found if r.kind == "session")
    assert sessions == [("a", 4, 1, 0, 1), ("b", 1, 0, 0, 0), ("b", 1, 0, 1, 0), ("c", 1, 0, 0, 0)]
    late = sorted((r.attempt_id, r.event_type, r.payload, r.received_us) for r in found if r.kind == "late")
    us = lambda minute: int((NOON + timedelta(minutes=minute) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert late == [("a", "blur", "{}", us(20)), ("a", "clipboard", paste, us(30))]
    named = sum(r[0] is not None for rows in batches for r in rows)
    assert sum(n for _, n, *_ in sessions) + len(late) == named
    first = next(r for r in found if r.attempt_id == "a" and r.kind == "session")
    assert (first.first_us, first.last_us, first.start_us, first.end_us) == (us(0), us(12), us(0), us(12))
    assert left[0] == 2 and left[-1] == 0


def test_sessions_that_a_row_bridges_are_one(spark):
    one = lambda a, b: {"start_us": a, "end_us": b, "event_count": 1, "paste_count": 0, "tab_hidden_count": 0, "submits": 0, "first_us": None, "last_us": a}
    assert [s["event_count"] for s in joined([one(0, 1), one(20, 21), one(10, 11)], 9)] == [3]
    assert [s["event_count"] for s in joined([one(0, 1), one(20, 21)], 9)] == [1, 1]
    rows = spark.createDataFrame([row("a", 0), row("a", 1), row("a", 90)], SCHEMA).select(
        F.unix_micros("received_at").alias("received_us"), *[F.lit(False).alias(c) for c in ("is_paste", "is_hidden", "is_submit")], F.lit(None).cast("double").alias("event_us"))
    assert [s["event_count"] for s in of_events(rows.toPandas(), 1800 * 10**6)] == [2, 1]


def test_attempts_share_states(spark):
    """A call costs more than the events of an attempt: there are as many as states, whatever the attempts."""
    source, target, progress = (fresh_path(spark, f"t_shared_{n}") for n in ("in", "out", "state"))
    names = [f"a{n}" for n in range(50)]
    batches = [[row(a, n % 7) for n, a in enumerate(names)], [row(a, 8, "exam_submitted") for a in names[::2]], [row(None, 1000)]]
    states = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = (attempt_sessions(stream, 600, 1800, buckets=3).writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", progress).trigger(availableNow=True).start())
        q.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(states) == 3 and states[-1] == 0
    found = sorted((r.attempt_id, r.event_count, r.submits, r.kind) for r in spark.read.parquet(target).collect())
    assert found == sorted((a, 2 - n % 2, 1 - n % 2, "session") for n, a in enumerate(names))
