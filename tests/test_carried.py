"""Batches that go on from what was kept, against scoring everything at once."""

from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMALL, same
from vigilframe.catalog import RULES
from vigilframe.plans.progressive import progressive_risk
from vigilframe.session import fresh_path
from vigilframe.sources.fixture import attempt_events, iso_time
from vigilframe.streaming import ingest

BATCHES = 4
COLUMNS = ("attempt_id", "risk", "confidence", "combined_score", "reason")


@pytest.fixture(scope="module")
def events(spark):
    """In event time order batch by batch; an attempt is not in every batch."""
    rows = attempt_events(spark, SMALL).where("attempt_id LIKE '%-0' OR attempt_id LIKE '2%'")
    rows = rows.withColumn("part", F.ntile(BATCHES).over(Window.partitionBy("attempt_id").orderBy("t_us")) - 1)
    rows = rows.where("part = 0 OR (crc32(attempt_id) + part) % 3 <> 0")
    received = F.lit(datetime(2024, 3, 1)).cast("timestamp") + F.make_dt_interval(hours=F.col("part") * 3)
    return rows.withColumn("received_at", received).cache()


def batch(events, n):
    payload = F.to_json(F.struct("action", "state", "question_id"))
    return events.where(F.col("part") == n).select(
        "attempt_id", "candidate_id", "candidate_name", "candidate_email", "assessment_id", "assessment_name",
        "event_type", payload.alias("payload"), iso_time("t_us").alias("occurred_at"), "received_at",
    )


def run(spark, events, ttl_s):
    paths = ingest.IngestPaths(fresh_path(spark, "t_carried"))
    for n in range(BATCHES):
        ingest.score_batch(batch(events, n), n, paths, patterns=RULES, ttl_s=ttl_s)
    return paths


@pytest.mark.parametrize("ttl_s", [4 * 3600.0, None])
def test_batches_in_order_read_no_stored_event(spark, events, ttl_s, monkeypatch):
    def never(*_):
        raise AssertionError("stored events were read")

    monkeypatch.setattr(ingest, "read_events", never)
    paths = run(spark, events, ttl_s)
    numbered = events.withColumns(
        {
            "arrival": F.col("part") * 10**12 + F.col("t_us") * 1000 + F.col("arrival") % 1000,
            "received_us": F.unix_micros("received_at"),
        }
    )
    every = progressive_risk(numbered, rules=RULES, ttl_s=ttl_s, instant="part")
    wanted = every.select("attempt_id", "risk", F.col("confidence_score").alias("confidence"), "combined_score", "reason")
    history = spark.read.parquet(paths.history)
    assert history.count() == events.count()
    assert same(wanted, history.select(*COLUMNS))
    kept = paths.kept.read(spark, BATCHES - 1)
    assert kept.count() <= events.select("attempt_id").distinct().count()


def test_late_attempts_only_are_read_again(spark, events, monkeypatch):
    """One attempt gets an event of long ago: of the stored events, its own are scored again."""
    paths = ingest.IngestPaths(fresh_path(spark, "t_one_late"))
    for n in range(2):
        ingest.score_batch(batch(events, n), n, paths, patterns=RULES)
    again = []
    real = ingest.carried_over

    def seen(rows, *rest):
        again.extend(r.attempt_id for r in rows.select("attempt_id").distinct().collect())
        return real(rows, *rest)

    monkeypatch.setattr(ingest, "carried_over", seen)
    one = events.where("part = 1").select(F.min("attempt_id")).first()[0]
    late = batch(events, 1).where(F.col("attempt_id") == one).limit(1).withColumn("occurred_at", F.lit("2020-01-01T00:00:00Z"))
    ingest.score_batch(batch(events, 2).unionByName(late), 2, paths, patterns=RULES)
    assert again == [one]
    monkeypatch.undo()
    whole = spark.read.parquet(paths.events)
    state = ingest.read_current_risk(spark, paths.state, 2)
    counts = whole.groupBy("attempt_id").agg(F.count("*").alias("event_count"))
    assert same(counts, state.select("attempt_id", "event_count"))
