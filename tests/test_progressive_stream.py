"""Event prefixes against brute force, and the stream against the batch."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, same
from vigilframe import catalog
from vigilframe.catalog import RULES, delayed_arrival
from vigilframe.plans.progressive import progressive_risk
from vigilframe.plans.score import score_attempts
from vigilframe.session import fresh_path
from vigilframe.sinks import writers
from vigilframe.sources import streams
from vigilframe.sources.fixture import attempt_events, iso_time
from vigilframe.streaming import ingest

COLUMNS = ("attempt_id", "risk", "confidence", "confidence_score", "combined_score", "pattern_count", "pattern_strength", "event_count", "explanation_text")


def brute_force(events):
    """Score the whole prefix of every arrival."""
    events = events.withColumn("client_seq", F.lit(0).cast("long"))
    ends = events.select("attempt_id", F.col("arrival").alias("n"))
    prefix = events.join(ends, "attempt_id").where("arrival <= n")
    keyed = prefix.withColumn("attempt_id", F.concat_ws("#", "attempt_id", "n"))
    return score_attempts(keyed, patterns=RULES).select(*COLUMNS)


def keyed(rows):
    return rows.withColumn("attempt_id", F.concat_ws("#", "attempt_id", "arrival")).select(*COLUMNS)


@pytest.mark.parametrize("late", [False, True])
def test_every_prefix(spark, late):
    events = attempt_events(spark, SMALL).where("attempt_id LIKE '%-0'")
    if late:
        events = events.withColumn("arrival", delayed_arrival())
    assert same(brute_force(events), keyed(progressive_risk(events, rules=RULES)))


def test_only_later_arrivals(spark):
    events = attempt_events(spark, SMALL).withColumn("arrival", delayed_arrival())
    middle = 60_000
    every = progressive_risk(events, rules=RULES).where(F.col("arrival") > middle)
    some = progressive_risk(events, rules=RULES, after_arrival=middle)
    assert same(keyed(every), keyed(some))


def test_late_events_of_one_instant_are_merged(spark):
    events = attempt_events(spark, SMALL).where("attempt_id LIKE '%-0'")
    events = events.withColumn("part", F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    arrival = F.col("part") * 10**12 + F.col("t_us") * 1000 + F.col("arrival") % 1000
    events = events.withColumns({"arrival": arrival, "client_seq": F.lit(0).cast("long")})
    newest = events.where("part = 0").groupBy("attempt_id").agg(F.max("t_us").alias("newest"))
    marked = events.join(newest, "attempt_id", "left").withColumn(
        "late", (F.col("part") == 1) & F.coalesce(F.col("t_us") < F.col("newest"), F.lit(False))
    )
    ends = marked.select("attempt_id", F.col("arrival").alias("n"), F.col("late").alias("n_late"))
    prefix = marked.join(ends, "attempt_id").where("arrival <= n OR (late AND n_late)")
    whole = prefix.withColumn("attempt_id", F.concat_ws("#", "attempt_id", "n"))
    wanted = score_attempts(whole, patterns=RULES).select(*COLUMNS)
    assert same(wanted, keyed(progressive_risk(events, rules=RULES, instant="part")))


def ingest_rows(events):
    payload = F.struct("action", "state", "question_id")
    return events.select(
        "attempt_id", "candidate_id", "candidate_name", "candidate_email", "assessment_id", "assessment_name",
        "event_type", payload.alias("payload"), iso_time("t_us").alias("occurred_at"), "arrival", "t_us",
    )


@pytest.fixture(scope="module")
def job(spark):
    """The job over three batches; the last one brings late events. Returns (events, paths, schema of files)."""
    events = attempt_events(spark, SMALL).where("attempt_id LIKE '%-0' OR attempt_id LIKE '1%'")
    part = F.when(F.col("k") % 13 == 0, 2).when(F.col("arrival") < 450, 0).otherwise(1)
    events = events.withColumn("part", part).cache()
    source = fresh_path(spark, "t_ingest")
    rows = ingest_rows(events).join(events.select("arrival", "part"), "arrival")
    paths = ingest.IngestPaths(fresh_path(spark, "t_job"))
    for n in range(3):
        rows.where(F.col("part") == n).drop("part", "arrival", "t_us").coalesce(1).write.mode("append").json(source)
        stream = streams.stream_events(spark, source)
        ingest.stream_score_attempts(stream, paths, patterns=RULES).awaitTermination()
    return events, paths


def test_stream_equals_batch(spark, job):
    events, paths = job
    arrival = F.col("part") * 10**12 + F.col("t_us") * 1000 + F.col("arrival") % 1000
    batch = progressive_risk(events.withColumn("arrival", arrival), rules=RULES, instant="part")
    history = spark.read.parquet(paths.history)
    assert history.count() == events.count()
    wanted = batch.select("attempt_id", "risk", F.col("confidence_score").alias("confidence"), "combined_score", "reason")
    assert same(wanted, history)


def test_state_is_the_score_of_the_whole_attempt(spark, job):
    events, paths = job
    state = ingest.read_current_risk(spark, paths.state, 2)
    whole = score_attempts(events.withColumn("client_seq", F.lit(0).cast("long")), patterns=RULES)
    assert same(whole.select("attempt_id", "risk", "combined_score", "event_count"), state)


def test_feed_and_log(spark, job):
    events, paths = job
    message = json.loads(spark.read.json(paths.feed).first().value)
    assert {"type", "mode", "latest_event", "timeline_point", "event_count"} <= set(message)
    assert message["timeline_point"]["risk"] == message["risk"]
    assert spark.read.json(paths.log).count() == events.count()


def test_repeated_batch_changes_nothing(spark, job):
    events, paths = job
    before = spark.read.parquet(paths.history).drop("timestamp").collect()
    again = spark.read.parquet(paths.events).where("batch_id = 2").drop("event_date", "batch_id", "arrival")
    rows = spark.createDataFrame(again.collect(), again.schema)
    ingest.score_batch(rows, 2, paths, patterns=RULES)
    after = spark.read.parquet(paths.history).drop("timestamp").collect()
    assert sorted(map(str, before)) == sorted(map(str, after))


def test_native_state_counts(spark, job):
    events, _paths = job
    source, target = fresh_path(spark, "t_state_in"), fresh_path(spark, "t_state_out")
    ingest_rows(events).drop("arrival", "t_us").write.json(source)
    state = ingest.stream_attempt_state(streams.stream_events(spark, source), 3600.0)
    assert state.isStreaming
    q = (state.writeStream.outputMode("complete").option("checkpointLocation", fresh_path(spark, "t_state_cp"))
         .trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(target)).start())
    q.awaitTermination()
    counts = events.groupBy("attempt_id").agg(F.count("*").alias("event_count"))
    assert same(counts, spark.read.parquet(target).select("attempt_id", "event_count"))


def test_a_batch_of_bad_events_only_stops_nothing(spark):
    """Rows that cannot be scored are kept, counted and quarantined; a state comes with the first good event."""
    schema = "attempt_id string, candidate_id string, candidate_name string, candidate_email string, assessment_id string, assessment_name string, event_type string, payload string, occurred_at string, received_at timestamp, _corrupt_record string"
    at = lambda s: datetime(2024, 1, 1, 12, 0, s)
    row = lambda attempt, kind, when, s, bad=None: (attempt, *[None] * 5, kind, "{}", when, at(s), bad)
    batches = [
        [row("a", None, "2024-01-01T12:00:00Z", 0), row("a", "blur", "never", 0), row(None, "blur", None, 0), row(None, None, None, 0, "{broken")],
        [row("a", "exam_started", "2024-01-01T12:00:05Z", 5)],
        [row("a", "blur", "never", 9), row("b", None, None, 9)],
        [row(None, "blur", "2024-01-01T12:00:05Z", 9)],
    ]
    paths = ingest.IngestPaths(fresh_path(spark, "t_bad"))
    for n, rows in enumerate(batches):
        ingest.score_batch(spark.createDataFrame(rows, schema), n, paths)
    assert spark.read.parquet(paths.events).count() == 5
    reasons = sorted(r.reason for r in spark.read.parquet(paths.quarantine).collect())
    assert reasons == ["Missing attempt_id"] * 2 + ["Missing event_type"] * 2 + ["Unreadable record"] + ["Unreadable time"] * 2
    assert spark.read.parquet(paths.history).count() == 2  # the good event, and the bad one after it
    state = ingest.read_current_risk(spark, paths.state, 3).collect()
    assert [(r.attempt_id, r.event_count, r.risk) for r in state] == [("a", 4, "LOW")]


def test_old_states_are_removed(spark):
    path = fresh_path(spark, "t_states")
    rows = spark.createDataFrame([("a", 1)], "attempt_id string, updated_at int")
    for n in range(5):
        writers.upsert_current_risk(rows, path, n)
    writers.drop_old_states(spark, path, 3)
    assert ingest.read_current_risk(spark, path, 2) is None and ingest.read_current_risk(spark, path, 3) is not None


def test_receipts_behind_the_watermark_are_found(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 10),), (datetime(2024, 1, 1, 12),)], "received_at timestamp")
    assert ingest.late_receipts(rows, datetime(2024, 1, 1, 12), 3600.0).count() == 1


def test_feed_and_log_are_compressed(spark, job):
    """A message repeats names and phrases: as plain text feed and log were most of what the job wrote."""
    _events, paths = job
    for table in (paths.feed, paths.log):
        files = list(Path(table).glob("batch_id=*/part-*"))
        assert files and all(f.name.endswith(".json.gz") for f in files)
        text = sum(len(r.value) + 1 for r in spark.read.text(table).collect())
        assert sum(f.stat().st_size for f in files) < text / 4


def test_source_of_the_streams_is_compressed(spark):
    """The lines that the stream queries read: as plain text they were a third of what the job moved and wrote."""
    path = catalog._ingest_json(spark, SMALL)
    files = list(Path(path).glob("part-*"))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == attempt_events(spark, SMALL).count()
    assert sum(f.stat().st_size for f in files) < sum(len(line) + 1 for line in lines) / 4


def test_job_without_expiry_writes_little(spark):
    """Everything that a batch leaves behind, live state included, is less than its messages were as plain text."""
    rows = ingest_rows(attempt_events(spark, SMALL)).drop("arrival", "t_us").withColumn("payload", F.to_json("payload"))
    paths = ingest.IngestPaths(fresh_path(spark, "t_little"))
    ingest.score_batch(rows.withColumn("received_at", F.lit(datetime(2024, 1, 1))), 0, paths, patterns=RULES, ttl_s=None)
    text = sum(len(r.value) + 1 for table in (paths.feed, paths.log) for r in spark.read.text(table).collect())
    assert sum(f.stat().st_size for f in Path(paths.root).rglob("*") if f.is_file()) < text
    assert writers.read_current_risk(spark, paths.state, 0).agg(F.sum("event_count")).first()[0] == rows.count()


def test_a_batch_is_read_once(spark):
    """Quarantine and events come from one pass over the source."""
    schema = "attempt_id string, candidate_id string, candidate_name string, candidate_email string, assessment_id string, assessment_name string, event_type string, payload string, occurred_at string, received_at timestamp"
    at = datetime(2024, 1, 1, 12)
    rows = [("a", *[None] * 5, "blur", "{}", f"2024-01-01T12:00:0{n}Z", at) for n in range(5)] + [(None, *[None] * 5, "blur", "{}", None, at)]
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    batch = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    paths = ingest.IngestPaths(fresh_path(spark, "t_once"))
    ingest.score_batch(batch, 0, paths)
    assert read.value == len(rows)
    assert spark.read.parquet(paths.quarantine).columns.count("_position") == 0
    assert spark.read.parquet(paths.events).count() == 5
