"""Every registered query: one per operator, over the fixture view of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilframe.config import PatternRules
from vigilframe.functions import review, scalar
from vigilframe.operators import (
    evaluate,
    features,
    history,
    learning,
    lookup,
    normalize,
    patterns,
    reports,
    scoring,
    sessions,
)
from vigilframe.operators.timeline import ORDER
from vigilframe.plans import progressive, score
from vigilframe.session import cut, fresh_path
from vigilframe.sinks import writers
from vigilframe.sources import fixture, readers, streams
from vigilframe.streaming import ingest
from vigilframe.streaming.sessions import attempt_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# fixture attempts are short: four questions already make a borderline pattern
RULES = PatternRules(medium_min_questions=4)
DIGITS = 6
#: Events in one record of a written batch, at most.
EVENTS_A_RECORD = 4096


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(
        *[F.round(F.col(n), DIGITS).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    )


# ---- inputs derived from the tables ---------------------------------------------------------------


def events(spark, sf_dir) -> DataFrame:
    return fixture.attempt_events(spark, sf_dir)


def scored(spark, sf_dir, **options) -> DataFrame:
    return score.score_attempts(events(spark, sf_dir), patterns=RULES, **options)


def attempt_rows(spark, sf_dir) -> DataFrame:
    """Scored attempts with identity, latest event and time of the last arrival."""
    last = lambda c: F.max_by(c, "arrival")
    return scored(
        spark,
        sf_dir,
        passthrough=("candidate_name", "candidate_email", "assessment_id", "assessment_name"),
        extra={
            "timestamp_us": F.max("received_us"),
            "latest_event_type": last("event_type"),
            "latest_question_id": last("question_id"),
            "latest_event_us": last("t_us"),
        },
    ).withColumn("status", review.exam_status(F.col("has_submit_event"), F.col("latest_event_type")))


def log_rows(spark, sf_dir) -> DataFrame:
    """Scored attempts in the shape of the score log, time in micros."""
    rows = scored(spark, sf_dir, extra={"timestamp_us": F.max("received_us")})
    return rows.select("timestamp_us", "attempt_id", "risk", "confidence", "confidence_score", "combined_score",
                       "explanation_text", score.feature_struct().alias("features"),
                       scoring.signal_items().alias("signal_items"))


def history_fixture(spark, sf_dir) -> DataFrame:
    rows = progressive.progressive_risk(
        events(spark, sf_dir),
        rules=RULES,
        passthrough=("candidate_name", "candidate_email", "assessment_name", "received_us"),
    )
    return rows.withColumnRenamed("received_us", "timestamp_us")


def labels(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("attempt_id").agg(
        *[F.first(c).alias(c) for c in ("expected_label", "is_edge_case", "profile")]
    )


def pairs(spark, sf_dir) -> DataFrame:
    return lookup.expected_predicted(labels(spark, sf_dir), scored(spark, sf_dir))


def seconds(*columns: str):
    return [(F.col(c) / 1_000_000).alias(c.replace("_us", "_s")) for c in columns]


# ---- sources ---------------------------------------------------------------------------------------


def _in_records(rows, *per_attempt) -> DataFrame:
    """Records (attempt_id, events) of at most EVENTS_A_RECORD events, as arrivals are unique, in order of arrival over
    all files: a long attempt goes on in later records."""
    part = F.expr(f"arrival div {EVENTS_A_RECORD}").alias("_part")
    by_arrival = lambda a, b: F.signum(a["arrival"] - b["arrival"]).cast("int")
    records = rows.groupBy("attempt_id", part).agg(
        *per_attempt, F.array_sort(F.collect_list(F.struct("arrival", "event")), by_arrival).alias("events")
    ).withColumn("events", F.col("events.event"))
    return records.repartitionByRange("_part", "attempt_id").sortWithinPartitions("_part", "attempt_id").drop("_part")


@query("scan_attempt_batches")
def _(spark, sf_dir):
    raw = fixture.raw_events(spark, sf_dir)
    event = F.struct("event_type", "occurred_at", F.from_json("payload", "map<string,string>").alias("payload"),
                     F.col("event_attempt_id").alias("attempt_id"), "client_seq")
    path = fresh_path(spark, "attempt_batches")
    _in_records(raw.select("attempt_id", "arrival", event.alias("event"))).write.json(path)
    order = F.row_number().over(W.partitionBy("attempt_id").orderBy("arrival")) - 1
    return readers.scan_attempt_batches(spark, path).select(
        "attempt_id", "event_attempt_id", "event_type", "occurred_at",
        F.get_json_object("payload", "$.question_id").alias("question_id"),
        "client_seq", order.cast("long").alias("arrival"))


@query("scan_raw_events")
def _(spark, sf_dir):
    path = fresh_path(spark, "raw_events")
    fixture.raw_events(spark, sf_dir).select(*readers.RAW_EVENT_COLUMNS).write.parquet(path)
    return readers.scoring_events(readers.scan_raw_events(spark, path)).select(
        "attempt_id", "event_type", "occurred_at", F.get_json_object("payload", "$.state").alias("state"), "arrival")


LATE_BATCHES = 3
FILES = 2
#: Rows in one file of the ingest stream, about.
ROWS_A_FILE = 250_000


def _files(spark, sf_dir) -> int:
    """Files in which each half of the ingest stream is written, and of which a micro-batch is made."""
    return max(FILES, -(-events(spark, sf_dir).count() // (2 * ROWS_A_FILE)))


def _ingest_json(spark, sf_dir, broken: bool = False) -> str:
    """All raw events as JSON lines; ``broken`` cuts some lines short and takes the attempt from others."""
    path = fresh_path(spark, "ingest")
    rows = fixture.raw_events(spark, sf_dir).withColumn("payload", F.from_json("payload", "map<string,string>"))
    value = F.to_json(F.struct(*[f.name for f in streams.INGEST_EVENT.fields]))
    if broken:
        rows = rows.withColumn("attempt_id", F.when(F.col("arrival") % 11 != 0, F.col("attempt_id")))
        value = F.when(F.col("arrival") % 13 == 0, F.substring(value, 1, 30)).otherwise(value)
    # two writes, so that the files of the first half are older than those of the second; a file is read by one task
    half, files = F.col("received_at") < "2024-01-16", _files(spark, sf_dir)
    for part in (rows.where(half), rows.where(~half)):
        part.repartitionByRange(files, "arrival").sortWithinPartitions("arrival").select(
            value.alias("value")).write.mode("append").option("compression", "gzip").text(path)
    return path


def _drain(stream: DataFrame, spark, name: str) -> DataFrame:
    """Run a stream to its end into a table and read that back."""
    target, state = fresh_path(spark, name), fresh_path(spark, name + "_progress")
    q = (stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(target)


@query("stream_events")
def _(spark, sf_dir):
    stream = streams.stream_events(spark, _ingest_json(spark, sf_dir))
    return _drain(stream, spark, "stream_events").select(
        "attempt_id", "event_type", "occurred_at", F.col("received_at").isNotNull().alias("stamped"))


def _log_file(spark, sf_dir) -> str:
    """A score log with some broken and incomplete lines."""
    rows = scored(spark, sf_dir, extra={"timestamp_us": F.max("received_us"), "last_k": F.max_by("k", "arrival")})
    stamp = F.expr("cast(timestampadd(MICROSECOND, timestamp_us - 1704067200000000, TIMESTAMP_NTZ'2024-01-01 00:00:00') as string)")
    lines = writers.score_log_rows(rows, F.when(rows["last_k"] % 9 == 0, F.lit("never")).otherwise(stamp))
    keyed = rows.select("attempt_id", "last_k")
    lines = lines.join(keyed, "attempt_id").withColumns({
        "risk": F.when(F.col("last_k") != 7, F.col("risk")),
        "confidence": F.when(F.col("last_k") % 9 == 1, F.lit("n/a")).otherwise(F.col("confidence").cast("string")),
    })
    value = F.to_json(F.struct(*[c for c in lines.columns if c != "last_k"]))
    broken = F.when(F.col("last_k") == 5, F.substring(value, 1, 40)).otherwise(value)
    path = fresh_path(spark, "score_log")
    lines.select(broken.alias("value")).write.text(path)
    return path


@query("scan_score_log")
def _(spark, sf_dir):
    return readers.scan_score_log(spark, _log_file(spark, sf_dir)).select(
        "attempt_id", "risk", "features.paste_count", "features.questions_seen",
        F.col("signals")["tab"]["score"].alias("tab_score"))


@query("coerce_log_types")
def _(spark, sf_dir):
    log = readers.coerce_log_types(readers.scan_score_log(spark, _log_file(spark, sf_dir)))
    return log.select("attempt_id", F.col("timestamp").isNotNull().alias("has_time"), "confidence",
                      "confidence_score", "combined_score")


def _labelled_file(spark, sf_dir) -> str:
    raw = fixture.attempt_events(spark, sf_dir).select(
        "attempt_id", "expected_label", "is_edge_case", "profile", "candidate_id", "arrival",
        F.struct("event_type", fixture.iso_time("t_us").alias("occurred_at"),
                 F.struct("action", "state", "question_id").alias("payload"),
                 F.col("client_seq").cast("string").alias("client_seq")).alias("event"))
    records = _in_records(
        raw,
        F.first("expected_label").alias("expected_label"),
        F.struct(F.first("candidate_id").alias("candidate_id")).alias("candidate"),
        F.first("profile").alias("profile"), F.first("is_edge_case").alias("is_edge_case"))
    path = fresh_path(spark, "labelled")
    records.select("attempt_id", "expected_label", "candidate", "events", "profile", "is_edge_case").write.json(path)
    return path


@query("scan_labelled_attempts")
def _(spark, sf_dir):
    rows = readers.labelled_attempts(spark, _labelled_file(spark, sf_dir))
    return rows.select("attempt_id", "expected_label", "candidate.candidate_id", "profile", "is_edge_case",
                       F.col("n_events").cast("int"), F.col("first_event.event_type").alias("first_event_type"))


@query("scan_training_csv")
def _(spark, sf_dir):
    rows = learning.train_features(scored(spark, sf_dir)).withColumn(
        "paste_count", F.when(F.col("paste_count") == 3, F.lit("three")).otherwise(F.col("paste_count").cast("string")))
    path = fresh_path(spark, "training")
    writers.write_training_csv(rows, path, "risk", learning.SERVE_COLUMNS)
    return readers.scan_training_csv(spark, path, "risk", learning.SERVE_COLUMNS)


# ---- sinks -----------------------------------------------------------------------------------------


@query("append_raw_events")
def _(spark, sf_dir):
    path = fresh_path(spark, "raw_table")
    raw = fixture.raw_events(spark, sf_dir).select(*readers.RAW_EVENT_COLUMNS)
    for half in (raw.where("id % 2 = 0"), raw.where("id % 2 = 1")):
        writers.append_raw_events(half, path)
    return spark.read.parquet(path).select(
        "id", "attempt_id", "event_type", "occurred_at", F.col("event_date").cast("string").alias("event_date"))


@query("append_score_log")
def _(spark, sf_dir):
    path = fresh_path(spark, "log")
    writers.append_score_log(writers.score_log_rows(scored(spark, sf_dir), F.lit("2024-01-01T00:00:00")), path)
    return readers.scan_score_log(spark, path).select("attempt_id", "risk", "features.*",
                                                      F.col("signals")["timing"]["score"].alias("timing_score"))


@query("append_risk_history")
def _(spark, sf_dir):
    path = fresh_path(spark, "history")
    rows = history_fixture(spark, sf_dir)
    writers.append_risk_history(writers.history_rows(rows, F.col("timestamp_us")), path, batch_id=0)
    return spark.read.parquet(path).select("attempt_id", "arrival", "risk", "confidence", "combined_score", "reason")


@query("upsert_current_risk")
def _(spark, sf_dir):
    path = fresh_path(spark, "state")
    rows = cut(history_fixture(spark, sf_dir).select("attempt_id", "arrival", "risk", "combined_score",
                                                     F.col("timestamp_us").alias("updated_at")))
    writers.upsert_current_risk(rows.where("arrival % 2 = 0"), path, 0)
    state = writers.upsert_current_risk(rows.where("arrival % 2 = 1"), path, 1)
    return state.select("attempt_id", "arrival", "risk", "combined_score")


@query("live_update_feed")
def _(spark, sf_dir):
    rows = progressive.progressive_risk(events(spark, sf_dir), rules=RULES,
                                        passthrough=("event_type", "candidate_id", "received_us"))
    feed = writers.live_update_feed(rows.withColumns({
        "payload": F.lit("{}"), "occurred_at": F.lit(""), "received_at": F.col("received_us").cast("string")}))
    field = lambda p: F.get_json_object("value", p)
    return feed.select("key", field("$.mode").alias("mode"), field("$.risk").alias("risk"),
                       field("$.latest_event.event_type").alias("event_type"),
                       field("$.event_count").cast("long").alias("event_count"),
                       field("$.timeline_point.timestamp").cast("long").alias("received_us"))


@query("write_training_csv")
def _(spark, sf_dir):
    path = fresh_path(spark, "refine_csv")
    rows = learning.rebuild_refine_dataset(events(spark, sf_dir), labels(spark, sf_dir), rules=RULES)
    writers.write_training_csv(rows, path, "label", learning.REFINE_COLUMNS)
    return readers.scan_training_csv(spark, path, "label", learning.REFINE_COLUMNS)


@query("write_eval_report")
def _(spark, sf_dir):
    path = fresh_path(spark, "report")
    both = cut(pairs(spark, sf_dir).select("attempt_id", "expected_label", "predicted_label"))
    writers.write_eval_report(evaluate.eval_metrics(both), evaluate.confusion_with_totals(both), path)
    return spark.read.option("header", True).schema(
        "expected_label string, LOW long, MEDIUM long, HIGH long, total long").csv(f"{path}/confusion")


@query("write_eval_report_metrics")
def _(spark, sf_dir):
    path = fresh_path(spark, "report")
    both = cut(pairs(spark, sf_dir).select("attempt_id", "expected_label", "predicted_label"))
    metrics = evaluate.eval_metrics(both)
    writers.write_eval_report(metrics, evaluate.confusion_with_totals(both), path)
    return spark.read.schema(metrics.schema).json(f"{path}/metrics")


def _training_split(spark, sf_dir):
    rows = learning.clean_training_set(learning.train_features(scored(spark, sf_dir)))
    return learning.stratified_split(cut(rows), "risk", "attempt_id", 0.8, 42)


@query("save_model")
def _(spark, sf_dir):
    """Whether the reloaded model says the same of every attempt."""
    train, _test = _training_split(spark, sf_dir)
    path = fresh_path(spark, "model")
    model = learning.train_risk_forest(train)
    learning.save_model(model, path)
    matrix = cut(learning.serve_features(scored(spark, sf_dir)))
    assert learning.predict_risk(learning.load_model(path + "-absent"), matrix) is None
    before = learning.predict_risk(model, matrix).select("attempt_id", "ml_risk", "ml_confidence")
    after = learning.predict_risk(learning.load_model(path), matrix).select(
        "attempt_id", F.col("ml_risk").alias("_risk"), F.col("ml_confidence").alias("_confidence"))
    return before.join(after, "attempt_id").select(
        "attempt_id", ((F.col("ml_risk") == F.col("_risk")) & (F.col("ml_confidence") == F.col("_confidence"))).alias("same"))


# ---- normalisation and filters ---------------------------------------------------------------------


@query("normalize_events")
def _(spark, sf_dir):
    return normalize.normalize_events(fixture.raw_events(spark, sf_dir)).select(
        "attempt_id", "arrival", "event_type", "action", "state", "question_id", "client_seq",
        (F.col("t_us") - F.lit(fixture.EPOCH_US)).alias("t_us"))


@query("rejected_events")
def _(spark, sf_dir):
    return normalize.rejected_events(fixture.raw_events(spark, sf_dir))


@query("ordered_events")
def _(spark, sf_dir):
    return normalize.ordered_events(events(spark, sf_dir)).select("attempt_id", "arrival", "event_rn")


FLAG_COLUMNS = ("is_paste", "is_tab_hidden", "is_tab_visible", "is_idle_start", "is_idle_end",
                "is_question_enter", "is_question_leave")


@query("event_flags")
def _(spark, sf_dir):
    return normalize.event_flags(events(spark, sf_dir)).select("attempt_id", "arrival", *FLAG_COLUMNS)


@query("events_for_attempt")
def _(spark, sf_dir):
    path = fresh_path(spark, "raw_for_one")
    writers.append_raw_events(fixture.raw_events(spark, sf_dir).select(*readers.RAW_EVENT_COLUMNS), path, digits=1)
    return readers.events_for_attempt(readers.scan_raw_events(spark, path), "5-0").select(
        "id", "attempt_id", "candidate_name", "event_type", "occurred_at")


@query("risk_history_for_attempt")
def _(spark, sf_dir):
    """The attempt is looked up in the stored events, and only it is scored."""
    path = fresh_path(spark, "events_for_one")
    stored = events(spark, sf_dir).withColumns({"received_at": F.timestamp_micros("received_us"), "occurred_at": F.col("t_us")})
    writers.append_raw_events(stored, path, digits=1)
    mine = readers.of_attempt(spark.read.parquet(path), "5-0")
    rows = progressive.progressive_risk(mine, rules=RULES, passthrough=("received_us",)).withColumnRenamed("received_us", "timestamp_us")
    return readers.risk_history_for_attempt(rows, "5-0", "timestamp_us").select(
        "attempt_id", "risk", "combined_score", "reason", "timestamp_us")


NOW_US = fixture.EPOCH_US + 3 * fixture.WEEK_US


@query("live_risk")
def _(spark, sf_dir):
    rows = history_fixture(spark, sf_dir).where(F.col("timestamp_us") <= NOW_US).select(
        "attempt_id", "risk", "combined_score", "event_count", F.col("timestamp_us").alias("updated_us"))
    return history.live_risk(rows, NOW_US)


@query("score_summary")
def _(spark, sf_dir):
    return score.score_summary(scored(spark, sf_dir))


@query("filter_attempt_log")
def _(spark, sf_dir):
    rows = reports.filter_attempt_log(log_rows(spark, sf_dir), ("HIGH", "MEDIUM"), "1-", "timestamp_us")
    return rows.select("attempt_id", "risk", "combined_score", "timestamp_us")


@query("search_attempts")
def _(spark, sf_dir):
    return reports.search_attempts(attempt_rows(spark, sf_dir), ("LOW", "HIGH"), "Date 1").select(
        "attempt_id", "risk", "candidate_name")


@query("violation_events")
def _(spark, sf_dir):
    return reports.violation_events(events(spark, sf_dir)).select("attempt_id", "arrival", "event_type", "label", "tone")


@query("flatten_features")
def _(spark, sf_dir):
    return reports.flatten_features(log_rows(spark, sf_dir))


def _signal_map(rows: DataFrame) -> DataFrame:
    return rows.withColumn("signals", F.map_from_entries(
        F.transform("signal_items", lambda s: F.struct(s["name"], F.struct(s["score"], s["components"])))))


@query("explode_signals")
def _(spark, sf_dir):
    return reports.explode_signals(_signal_map(log_rows(spark, sf_dir)))


@query("attempt_drilldown")
def _(spark, sf_dir):
    return reports.attempt_drilldown(log_rows(spark, sf_dir), "8-0", "timestamp_us")


# ---- joins -----------------------------------------------------------------------------------------


@query("asof_prev_event")
def _(spark, sf_dir):
    return lookup.asof_event(events(spark, sf_dir), F.col("is_paste"), F.col("is_tab_hidden"), 30.0)


@query("asof_next_event")
def _(spark, sf_dir):
    return lookup.asof_event(events(spark, sf_dir), F.col("is_paste"), F.col("is_question_leave"), 30.0, "next")


@query("paste_attribution")
def _(spark, sf_dir):
    return lookup.paste_attribution(events(spark, sf_dir), F.col("is_answer"), scalar.paste_size_category(F.col("k") * 2))


@query("join_ml_predictions")
def _(spark, sf_dir):
    return score.join_predictions(scored(spark, sf_dir).drop("ml_risk", "ml_confidence"), _predictions(spark, sf_dir)
                                  ).select("attempt_id", "ml_risk", "ml_confidence")


def _predictions(spark, sf_dir) -> DataFrame:
    """Stand-in predictions computed from the labels table, for two thirds of the attempts."""
    n = F.count("*")
    rows = events(spark, sf_dir).groupBy("attempt_id").agg(n.alias("n"), F.max("k").alias("m"))
    return rows.where("m % 3 <> 0").select(
        "attempt_id",
        F.when(F.col("m") % 3 == 1, "MEDIUM").otherwise("HIGH").alias("ml_risk"),
        ((F.col("n") * 7 % 50 + 50) / 100).alias("ml_confidence"))


@query("join_expected_predicted")
def _(spark, sf_dir):
    return pairs(spark, sf_dir).select("attempt_id", "expected_label", "predicted_label")


@query("prefix_expand")
def _(spark, sf_dir):
    return lookup.prefix_stats(events(spark, sf_dir))


@query("touched_attempts")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    batch = rows.where(F.col("received_us") >= fixture.EPOCH_US + 4 * fixture.WEEK_US)
    return lookup.touched_attempts(rows, batch).select("attempt_id", "arrival")


@query("report_identity_fallback")
def _(spark, sf_dir):
    rows = attempt_rows(spark, sf_dir).withColumns({
        "candidate_name": F.when(F.col("event_count") % 2 == 0, F.col("candidate_name")),
        "candidate_email": F.when(F.col("event_count") % 3 == 0, F.lit("")),
        "assessment_name": F.lit(None).cast("string")})
    seen = events(spark, sf_dir).withColumn("assessment_name", F.when(F.col("k") % 2 == 0, F.col("assessment_name")))
    return lookup.report_identity(rows, seen, history_fixture(spark, sf_dir))


# ---- features --------------------------------------------------------------------------------------


def _one_feature(name: str):
    @query(f"f_{name}")
    def _(spark, sf_dir):
        return features.attempt_features(events(spark, sf_dir), RULES).select("attempt_id", name)


for _name in ("paste_count", "tab_hidden_count", "idle_spike_count", "time_per_question_mean_s", "questions_seen",
              "attempt_duration_s"):
    _one_feature(_name)


@query("f_question_durations")
def _(spark, sf_dir):
    return features.question_durations(events(spark, sf_dir))


@query("attempt_features")
def _(spark, sf_dir):
    return features.attempt_features(events(spark, sf_dir), RULES).select("attempt_id", *features.FEATURE_COLUMNS)


@query("attempt_features_ext")
def _(spark, sf_dir):
    return features.attempt_features(events(spark, sf_dir), RULES, extended=True).select(
        "attempt_id", "client_seq_gaps", "has_submit_event", *features.RATIO_COLUMNS)


EVENT_TYPES = ("question_view", "question_answer", "clipboard", "visibility_change", "idle_state", "exam_started",
               "exam_submitted")


@query("attempt_event_counts")
def _(spark, sf_dir):
    return features.event_counts(events(spark, sf_dir), EVENT_TYPES)


def _one_sequence_feature(name: str):
    @query(f"f_{name}")
    def _(spark, sf_dir):
        return features.attempt_features(events(spark, sf_dir), RULES, sequences=True).select("attempt_id", name)


for _name in features.SEQUENCE_COLUMNS:
    _one_sequence_feature(_name)


# ---- scoring ---------------------------------------------------------------------------------------


@query("detect_signals")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("attempt_id", "avg_time", *[f"{n}_score" for n in scoring.ScoringRules().weights])


@query("combine_signals")
def _(spark, sf_dir):
    rows = features.attempt_features(events(spark, sf_dir), RULES)
    return scoring.combine_signals(scoring.detect_signals(rows)).select(
        "attempt_id", "base_score", "combined_score", "elevated_count", "strong_count", "support_count", "bonus")


@query("assign_risk")
def _(spark, sf_dir):
    rows = scoring.combine_signals(scoring.detect_signals(features.attempt_features(events(spark, sf_dir), RULES)))
    return rows.select("attempt_id", scoring.assign_risk(F.col("combined_score")).alias("risk"))


@query("promote_by_pattern")
def _(spark, sf_dir):
    rows = patterns.summarise_patterns(
        scoring.combine_signals(scoring.detect_signals(features.attempt_features(events(spark, sf_dir), RULES))), RULES)
    rows = rows.withColumn("rule_risk", scoring.assign_risk(F.col("combined_score")))
    return scoring.promote_by_pattern(rows).select("attempt_id", "rule_risk", "promoted_by_pattern")


@query("hybrid_decision")
def _(spark, sf_dir):
    return scored(spark, sf_dir, predictions=_predictions(spark, sf_dir)).select(
        "attempt_id", "rule_risk", "ml_risk", "risk", "promoted_by_pattern")


@query("low_data_guard")
def _(spark, sf_dir):
    return scored(spark, sf_dir).where("low_data").select(
        "attempt_id", "risk", "confidence", "confidence_score", "base_score", "combined_score", "explanation_text")


@query("rule_confidence")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("attempt_id", "confidence")


@query("evidence_confidence")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("attempt_id", "confidence_score")


@query("blend_confidence")
def _(spark, sf_dir):
    return scored(spark, sf_dir, predictions=_predictions(spark, sf_dir)).select("attempt_id", "confidence_score")


RESULT = ("attempt_id", "risk", "confidence", "confidence_score", "promoted_by_pattern", "base_score", "combined_score",
          "pattern_count", "pattern_strength", "explanation_text")


@query("score_attempts")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select(*RESULT)


def _stand_in(rows: DataFrame) -> DataFrame:
    """In place of a trained model: predictions that SQL can repeat."""
    kind = (F.col("paste_count") * 3 + F.col("tab_hidden_count")) % 3
    return rows.withColumns({
        "ml_risk": F.when(kind == 1, "MEDIUM").when(kind == 2, "HIGH").otherwise("LOW"),
        "ml_confidence": ((F.col("paste_count") * 7 + F.col("tab_hidden_count") * 11) % 50 + 50) / 100})


@query("score_attempts_with_model")
def _(spark, sf_dir):
    return scored(spark, sf_dir, predict=_stand_in).select(*RESULT)


@query("score_attempts_extended")
def _(spark, sf_dir):
    return scored(spark, sf_dir, extended=True).select(*RESULT)


# ---- evaluation and dashboards ---------------------------------------------------------------------


@query("confusion_matrix")
def _(spark, sf_dir):
    return evaluate.confusion_matrix(pairs(spark, sf_dir))


@query("confusion_with_totals")
def _(spark, sf_dir):
    return evaluate.confusion_with_totals(pairs(spark, sf_dir))


@query("eval_metrics")
def _(spark, sf_dir):
    return evaluate.eval_metrics(pairs(spark, sf_dir))


@query("predicted_distribution")
def _(spark, sf_dir):
    return evaluate.label_counts(pairs(spark, sf_dir), "predicted_label")


@query("classification_report")
def _(spark, sf_dir):
    return evaluate.classification_report(pairs(spark, sf_dir))


@query("binary_metrics")
def _(spark, sf_dir):
    both = pairs(spark, sf_dir).where("expected_label <> 'HIGH'")
    return evaluate.binary_metrics(both.select(
        scalar.label_to_int(F.col("expected_label")).alias("label"),
        F.when(F.col("predicted_label") == "LOW", 0).otherwise(1).alias("prediction")))


@query("per_attempt_eval")
def _(spark, sf_dir):
    return evaluate.per_attempt_eval(pairs(spark, sf_dir)).drop("edge_case_scenario")


@query("label_profile_distribution")
def _(spark, sf_dir):
    return evaluate.label_profile_distribution(labels(spark, sf_dir))


@query("class_distribution")
def _(spark, sf_dir):
    return evaluate.class_distribution(learning.train_features(scored(spark, sf_dir)))


@query("dashboard_kpis")
def _(spark, sf_dir):
    return reports.dashboard_kpis(log_rows(spark, sf_dir))


@query("console_stats")
def _(spark, sf_dir):
    return reports.console_stats(attempt_rows(spark, sf_dir))


@query("risk_distribution")
def _(spark, sf_dir):
    return reports.risk_distribution(log_rows(spark, sf_dir))


@query("feature_means_by_risk")
def _(spark, sf_dir):
    return reports.feature_means_by_risk(reports.flatten_features(log_rows(spark, sf_dir)))


@query("score_trend")
def _(spark, sf_dir):
    return reports.score_trend(log_rows(spark, sf_dir), "timestamp_us")


@query("risk_options")
def _(spark, sf_dir):
    return reports.risk_options(log_rows(spark, sf_dir))


# ---- patterns --------------------------------------------------------------------------------------


def _pattern_query(name: str, kind: str):
    @query(name)
    def _(spark, sf_dir):
        found = patterns.detect_patterns(events(spark, sf_dir), RULES, extended=kind == patterns.MEDIUM_TAB)
        return found.where(F.col("pattern_type") == kind)


_pattern_query("pattern_idle_tab_paste_fast", patterns.SEQUENCE)
_pattern_query("pattern_high_tab_low_time", patterns.HIGH_TAB)
_pattern_query("pattern_medium_tab_low_time", patterns.MEDIUM_TAB)
_pattern_query("pattern_medium_idle_fast", patterns.QUICK_LEAVE)


@query("detect_patterns")
def _(spark, sf_dir):
    return patterns.detect_patterns(events(spark, sf_dir), RULES)


def _default_query(name: str, kind: str, extended: bool):
    @query(name)
    def _(spark, sf_dir):
        found = patterns.detect_patterns(events(spark, sf_dir), PatternRules(), extended=extended)
        return found.where(F.col("pattern_type") == kind)


_default_query("pattern_medium_tab_low_time_default", patterns.MEDIUM_TAB, True)
_default_query("pattern_medium_idle_fast_default", patterns.QUICK_LEAVE, False)


@query("score_attempts_default")
def _(spark, sf_dir):
    return score.score_attempts(events(spark, sf_dir), patterns=PatternRules()).select(*RESULT)


@query("pattern_summary")
def _(spark, sf_dir):
    top = lambda i: F.try_element_at("top_patterns", F.lit(i))["pattern_type"]
    return scored(spark, sf_dir).where("pattern_count > 0").select(
        "attempt_id", "pattern_count", "pattern_strength", top(1).alias("first_pattern"), top(2).alias("second_pattern"))


# ---- windows ---------------------------------------------------------------------------------------


@query("latest_per_attempt")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.split("attempt_id", "-")[0].alias("attempt_id"), "arrival",
        F.when(F.col("k") % 6 == 0, F.col("received_us") - 86_400_000_000 * 5).otherwise(F.col("received_us")).alias("timestamp_us"),
        F.when(F.col("k") % 2 == 0, F.col("event_type")).alias("event_type"), "state", "question_id")
    return history.latest_per_attempt(rows, "timestamp_us", "arrival")


PROGRESS = ("attempt_id", "arrival", "event_count", "paste_count", "tab_hidden_count", "idle_spike_count",
            "questions_seen", "time_per_question_mean_s", "attempt_duration_s", "risk", "confidence",
            "confidence_score", "combined_score", "pattern_count", "pattern_strength", "reason")


@query("progressive_risk")
def _(spark, sf_dir):
    return progressive.progressive_risk(events(spark, sf_dir), rules=RULES).select(*PROGRESS)


@query("progressive_risk_with_predictions")
def _(spark, sf_dir):
    return progressive.progressive_risk(events(spark, sf_dir), rules=RULES, predict=_stand_in).select(*PROGRESS)


@query("progressive_risk_ttl")
def _(spark, sf_dir):
    return progressive.progressive_risk(events(spark, sf_dir), rules=RULES, ttl_s=history.TTL_S).select(
        "session_id", *PROGRESS)


@query("progressive_risk_late")
def _(spark, sf_dir):
    late = events(spark, sf_dir).withColumn("arrival", delayed_arrival())
    return progressive.progressive_risk(late, rules=RULES).select(*PROGRESS)


def delayed_arrival():
    """Every seventh value of k arrives 600 events late."""
    return F.when(F.col("k") % 7 == 0, F.col("arrival") + 600).otherwise(F.col("arrival")) * 100 + F.col("k")


@query("risk_transitions")
def _(spark, sf_dir):
    return history.risk_transitions(
        history_fixture(spark, sf_dir).select("attempt_id", "arrival", "risk", "combined_score"), ("arrival",))


@query("cache_sessions")
def _(spark, sf_dir):
    return history.cache_sessions(events(spark, sf_dir)).select("attempt_id", "arrival", "session_id")


@query("retain_latest_n")
def _(spark, sf_dir):
    return history.retain_newest(
        log_rows(spark, sf_dir).select("attempt_id", "risk", "timestamp_us"), 500,
        F.col("timestamp_us").desc(), F.col("attempt_id").asc())


@query("retain_latest_clamped")
def _(spark, sf_dir):
    """A wish for 5 events per attempt, kept between the bounds of the operator."""
    rows = events(spark, sf_dir).withColumn("attempt_id", F.split("attempt_id", "-")[0])
    return history.retain_newest_per_attempt(rows, 5).select("attempt_id", "arrival")


@query("retain_latest_per_attempt")
def _(spark, sf_dir):
    return history.newest_per_attempt(events(spark, sf_dir), 5).select("attempt_id", "arrival")


@query("top_signals")
def _(spark, sf_dir):
    rows = scored(spark, sf_dir).select("attempt_id", F.posexplode(scoring.top_signals(3)).alias("position", "s"))
    return rows.select("attempt_id", "position", "s.name", "s.score")


# ---- sorts and limits ------------------------------------------------------------------------------


@query("top_alerts")
def _(spark, sf_dir):
    return reports.top_alerts(log_rows(spark, sf_dir), time="timestamp_us")


@query("log_explorer")
def _(spark, sf_dir):
    return reports.log_explorer(log_rows(spark, sf_dir), time="timestamp_us")


@query("review_queue")
def _(spark, sf_dir):
    return reports.review_queue(attempt_rows(spark, sf_dir), time="timestamp_us")


@query("panel_top8")
def _(spark, sf_dir):
    return reports.panel_top(attempt_rows(spark, sf_dir), time="timestamp_us")


# ---- scalar functions ------------------------------------------------------------------------------


@query("clamp01")
def _(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 20 - F.col("l_tax") * 10)
    return line.select("l_orderkey", "l_linenumber", scalar.clamp01(x).alias("clamped"))


@query("ramp")
def _(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        "l_orderkey", "l_linenumber",
        scalar.named_ramp(F.col("l_discount") * 4, "tab_hidden_ratio").alias("rising"),
        scalar.named_ramp(F.col("l_quantity") / 5, "p10_time_s").alias("falling"))


@query("parse_event_time")
def _(spark, sf_dir):
    raw = fixture.raw_events(spark, sf_dir)
    text = F.when(F.col("arrival") % 5 == 0, F.replace("occurred_at", F.lit("Z"), F.lit("+05:30"))).otherwise(F.col("occurred_at"))
    return raw.select("id", (F.unix_micros(scalar.parse_event_time(text)) - F.lit(fixture.EPOCH_US)).alias("t_us"))


@query("risk_labels")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", " medium ", "none")]),
                         (F.col("o_orderkey") % 5 + 1).cast("int"))
    return orders.select("o_orderkey", scalar.risk_rank(label).alias("rank"), scalar.map_risk(label).alias("mapped"),
                         scalar.label_to_int(label).alias("binary"))


@query("safe_label")
def _(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.element_at(F.array(*[F.lit(x) for x in ("LOW", "Medium", " high", "", "unknown")]),
                         (F.col("o_orderkey") % 5 + 1).cast("int"))
    return orders.select("o_orderkey", scalar.safe_label(label).alias("label"))


@query("fixed_numbers")
def _(spark, sf_dir):
    # thirds are never rounding ties
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x = F.col("o_orderkey") / 3000.0 + 1.0 / 7
    return orders.select("o_orderkey", scalar.fixed(x, 1).alias("one"), scalar.fixed(x, 2).alias("two"),
                         scalar.percent(x).alias("pct"))


@query("format_duration")
def _(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice") / 7 - 500)
    return line.select("l_orderkey", "l_linenumber", scalar.format_duration(s).alias("text"))


@query("paste_size_category")
def _(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.when(F.col("l_linenumber") != 5, F.col("l_quantity") * 4 - 10)
    return line.select("l_orderkey", "l_linenumber", scalar.paste_size_category(n).alias("size"))


@query("build_reason")
def _(spark, sf_dir):
    rows = scored(spark, sf_dir)
    text = F.when(F.col("questions_seen") % 3 == 0, F.lit("  ")).otherwise(F.repeat("explanation_text", 3))
    return rows.select("attempt_id", review.build_reason(F.col("risk"), text).alias("reason"))


@query("primary_issue")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("attempt_id", review.primary_issue().alias("issue"))


@query("report_texts")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("attempt_id", review.decision_text(F.col("risk")).alias("decision"),
                                        review.report_summary(F.col("risk")).alias("summary"))


@query("evidence_items")
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("attempt_id", F.explode(review.evidence_items()).alias("e")).select(
        "attempt_id", "e.pos", "e.title", "e.severity", "e.finding", "e.explanation")


@query("exam_status")
def _(spark, sf_dir):
    return attempt_rows(spark, sf_dir).select("attempt_id", "status")


@query("exam_status_extended")
def _(spark, sf_dir):
    """From the submissions themselves instead of the constant feature."""
    rows = scored(spark, sf_dir, extended=True, extra={"latest_event_type": F.max_by("event_type", "arrival")})
    return rows.select("attempt_id", review.exam_status(F.col("has_submit_event"), F.col("latest_event_type")).alias("status"))


@query("latest_activity")
def _(spark, sf_dir):
    rows = attempt_rows(spark, sf_dir).withColumn(
        "latest_event_type", F.when(F.col("event_count") % 3 != 0, F.col("latest_event_type")))
    text = F.when(F.col("event_count") % 2 == 0, F.col("explanation_text"))
    return rows.select("attempt_id", review.latest_activity(F.col("latest_event_type"), F.col("latest_question_id"), text).alias("activity"),
                       F.coalesce(F.when(F.col("event_count") % 3 != 0, F.col("latest_event_us")), F.col("timestamp_us")).alias("activity_us"))


@query("display_defaults")
def _(spark, sf_dir):
    shown = reports.attempt_display()
    return attempt_rows(spark, sf_dir).select("attempt_id", *[c.alias(n) for n, c in shown.items()], "event_count")


@query("explain_attempts")
def _(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select("attempt_id", F.array_join("summary", "|").alias("summary"), F.array_join("reasons", "|").alias("reasons"))


@query("explanation_text")
def _(spark, sf_dir):
    return scored(spark, sf_dir, predictions=_predictions(spark, sf_dir)).select("attempt_id", "explanation_text")


# ---- streaming and sessions ------------------------------------------------------------------------


@query("stream_score_attempts")
def _(spark, sf_dir):
    paths = ingest.IngestPaths(fresh_path(spark, "ingest_job"))
    stream = streams.stream_events(spark, _ingest_json(spark, sf_dir), max_files=_files(spark, sf_dir))
    ingest.stream_score_attempts(stream, paths, patterns=RULES).awaitTermination()
    return spark.read.parquet(paths.history).select("attempt_id", "risk", "confidence", "combined_score", "reason")


@query("stream_current_risk")
def _(spark, sf_dir):
    """The live state after the last batch; every stored event counts."""
    paths = ingest.IngestPaths(fresh_path(spark, "ingest_job"))
    stream = streams.stream_events(spark, _ingest_json(spark, sf_dir), max_files=_files(spark, sf_dir))
    ingest.stream_score_attempts(stream, paths, patterns=RULES, ttl_s=None).awaitTermination()
    return writers.read_current_risk(spark, paths.state, 1).select("attempt_id", "event_count")


@query("stream_quarantine")
def _(spark, sf_dir):
    """What the job could not score, from a stream with broken lines and rows without attempt."""
    paths = ingest.IngestPaths(fresh_path(spark, "ingest_job"))
    stream = streams.stream_events(spark, _ingest_json(spark, sf_dir, broken=True), max_files=_files(spark, sf_dir))
    ingest.stream_score_attempts(stream, paths, patterns=RULES).awaitTermination()
    return spark.read.parquet(paths.quarantine).groupBy("reason").agg(F.count("*").alias("n"))


@query("stream_attempt_state")
def _(spark, sf_dir):
    """Closed sessions; a last row without attempt moves the clock on, so that all of them close."""
    source = _ingest_json(spark, sf_dir)
    spark.range(1).select(F.lit('{"event_type":"heartbeat"}').alias("value")).write.mode("append").text(source)
    clock = F.when(F.col("attempt_id").isNull(), F.col("received_at") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("received_at"))
    stream = streams.stream_events(spark, source).withColumn("received_at", clock)
    found = _drain(attempt_sessions(stream, late_s=3600.0), spark, "attempt_sessions")
    us = lambda c: (F.col(c) - F.lit(fixture.EPOCH_US)).alias(c)
    return found.where("kind = 'session'").select(
        "attempt_id", "event_count", "paste_count", "tab_hidden_count", "submits", us("first_us"), us("last_us"))


@query("late_event_policy")
def _(spark, sf_dir):
    late = events(spark, sf_dir).withColumn("arrival", delayed_arrival())
    return ingest.late_events(late, 20.0).select("attempt_id", "arrival", "late_by_s")


@query("stream_late_events")
def _(spark, sf_dir):
    """The same rows from a stream of several batches, each with the arrivals of its time."""
    source, root = fresh_path(spark, "late_source"), fresh_path(spark, "late_job")
    late = events(spark, sf_dir).withColumn("arrival", delayed_arrival()).select("attempt_id", "arrival", "t_us")
    late = cut(late)
    last = late.agg(F.max("arrival")).first()[0] or 0
    for part in range(LATE_BATCHES):  # one after the other, as files are taken by their age
        mine = late.where(F.floor(F.col("arrival") * LATE_BATCHES / F.lit(last + 1)) == part)
        mine.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.stream_late_events(stream, root, 20.0).awaitTermination()
    return spark.read.parquet(f"{root}/late").select("attempt_id", "arrival", "late_by_s")


@query("idle_sessions")
def _(spark, sf_dir):
    return sessions.idle_sessions(events(spark, sf_dir))


@query("typing_sessions")
def _(spark, sf_dir):
    return sessions.typing_sessions(events(spark, sf_dir), F.col("event_type") == "question_answer", 8.0)


@query("focus_sessions")
def _(spark, sf_dir):
    return sessions.focus_sessions(events(spark, sf_dir))


# ---- learning --------------------------------------------------------------------------------------


@query("ml_features_serve")
def _(spark, sf_dir):
    return learning.serve_features(scored(spark, sf_dir))


@query("ml_features_train")
def _(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("risk", F.when(F.col("event_count") % 9 != 0, F.col("risk")).otherwise("?"))
    return learning.train_features(rows)


@query("ml_features_refine")
def _(spark, sf_dir):
    return learning.refine_features(features.attempt_features(events(spark, sf_dir), RULES, sequences=True))


@query("clean_training_set")
def _(spark, sf_dir):
    rows = learning.train_features(scored(spark, sf_dir)).withColumns({
        "risk": F.when(F.col("questions_seen") == 2, F.lit("two")).otherwise(F.col("risk").cast("string")),
        "speed": F.when(F.col("paste_count") != 4, F.col("speed")),
        "tab_score": F.lit(0.5)})
    return learning.clean_training_set(rows)


@query("stratified_split")
def _(spark, sf_dir):
    train, test = _training_split(spark, sf_dir)
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("risk", "side").agg(F.count("*").alias("n"))


@query("scale_features")
def _(spark, sf_dir):
    rows = cut(learning.train_features(scored(spark, sf_dir)))
    return learning.scale_features(rows, learning.fit_scaler(rows, learning.SERVE_COLUMNS))


def _beats_majority(pairs: DataFrame):
    """Whether more of (label, predicted) agree than have the most frequent label."""
    cells = pairs.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits")).collect()
    return F.lit(sum(c.hits for c in cells) > max((c.n for c in cells), default=0))


@query("train_risk_forest")
def _(spark, sf_dir):
    """The confusion cells of the test part add up to the size of each class, and most are on the diagonal."""
    train, test = _training_split(spark, sf_dir)
    predicted = learning.predict_risk(learning.train_risk_forest(train), test)
    known = test.select("attempt_id", F.element_at(F.array(*[F.lit(x) for x in learning.LABELS]), F.col("risk") + 1).alias("expected_label"))
    both = known.join(predicted.withColumnRenamed("ml_risk", "predicted_label"), "attempt_id")
    both = cut(both.select("attempt_id", "expected_label", "predicted_label"))
    cells = evaluate.confusion_matrix(both)
    skilled = _beats_majority(both.select(F.col("expected_label").alias("label"), F.col("predicted_label").alias("predicted")))
    return cells.select(
        "expected_label", (F.col("LOW") + F.col("MEDIUM") + F.col("HIGH")).alias("n"), skilled.alias("beats_majority"))


@query("feature_importance")
def _(spark, sf_dir):
    """Names in their order, with weights that are shares of one, and none that all share alike."""
    train, _test = _training_split(spark, sf_dir)
    rows = learning.feature_importance(learning.train_risk_forest(train), spark)
    total = F.sum("importance").over(W.partitionBy(F.lit(0)))
    return rows.select("feature", (F.abs(total - 1) < 1e-9).alias("adds_up"), F.col("importance").between(0, 1).alias("is_share"),
        (F.max("importance").over(W.partitionBy(F.lit(0))) > 2 / len(learning.SERVE_COLUMNS)).alias("tells_apart"))


@query("predict_risk")
def _(spark, sf_dir):
    """Of every attempt: a known label, probabilities that add up to one, and their maximum as confidence; and whether
    the labels are right more often than the most frequent one."""
    train, _test = _training_split(spark, sf_dir)
    rows = cut(learning.serve_features(scored(spark, sf_dir), keep=("attempt_id", "risk")))
    predicted = cut(learning.predict_risk(learning.train_risk_forest(train), rows))
    known = rows.select("attempt_id", F.col("risk").alias("label"))
    skilled = _beats_majority(known.join(predicted.withColumnRenamed("ml_risk", "predicted"), "attempt_id"))
    p = F.map_values("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return predicted.select(
        "attempt_id", F.col("ml_risk").isin(*learning.LABELS).alias("known_label"), (F.abs(total - 1) < 1e-9).alias("adds_up"),
        (F.col("ml_confidence") == F.array_max(p)).alias("is_maximum"), skilled.alias("beats_majority"))


@query("predict_in_plan")
def _(spark, sf_dir):
    """The model inside the scoring plan agrees with its predictions for the feature rows."""
    train, _test = _training_split(spark, sf_dir)
    model = learning.train_risk_forest(train)
    rows = cut(scored(spark, sf_dir, predict=learning.predictor(model)).select(
        "attempt_id", F.col("ml_risk").alias("_risk"), F.col("ml_confidence").alias("_confidence")))
    apart = learning.predict_risk(model, learning.serve_features(scored(spark, sf_dir)))
    return rows.join(apart, "attempt_id").select(
        "attempt_id", ((F.col("ml_risk") == F.col("_risk")) & (F.col("ml_confidence") == F.col("_confidence"))).alias("same"))


#: Least difference of the mean predictions of both classes; a constant has none.
LEAST_APART = 0.1


def _refine_split(spark, sf_dir):
    rows = learning.rebuild_refine_dataset(events(spark, sf_dir), labels(spark, sf_dir), sequences=True, rules=RULES)
    rows = cut(rows.withColumn("label", scalar.label_to_int(F.col("label"))))
    return learning.stratified_split(rows, "label", "attempt_id", 0.75, 23)


def _refine_report(model, test):
    """Predictions of the test part by label: how many, all of them probabilities, and clearly higher for MEDIUM."""
    p = cut(test.select("attempt_id", "label").join(learning.predict_medium(model, test), "attempt_id"))
    of = lambda label: F.coalesce(F.avg(F.when(F.col("label") == label, F.col("p_medium"))), F.lit(0.0))
    apart = p.agg((of(1) - of(0)).alias("apart")).first()["apart"]
    found = p.groupBy("label").agg(F.count("*").alias("n"), F.bool_and(F.col("p_medium").between(0, 1)).alias("probabilities"))
    return found.withColumn("tells_apart", F.lit(apart > LEAST_APART))


@query("train_refine_logistic")
def _(spark, sf_dir):
    train, test = _refine_split(spark, sf_dir)
    return _refine_report(learning.train_refine_logistic(train), test)


@query("train_refine_newton")
def _(spark, sf_dir):
    """The weights themselves, after ten Newton steps over all labelled attempts."""
    rows = learning.rebuild_refine_dataset(events(spark, sf_dir), labels(spark, sf_dir), sequences=True, rules=RULES)
    rows = rows.withColumn("label", scalar.label_to_int(F.col("label")))
    model = learning.newton_logistic(rows)
    return model.rows(spark).select("feature", F.round("weight", 6).alias("weight"))


@query("train_refine_forest")
def _(spark, sf_dir):
    train, test = _refine_split(spark, sf_dir)
    return _refine_report(learning.train_refine_forest(train), test)


@query("rebuild_refine_dataset")
def _(spark, sf_dir):
    return learning.rebuild_refine_dataset(events(spark, sf_dir), labels(spark, sf_dir), sequences=True, rules=RULES)


@query("refine_low_medium")
def _(spark, sf_dir):
    rows = features.attempt_features(events(spark, sf_dir), RULES, sequences=True)
    result = scored(spark, sf_dir).select("attempt_id", "risk", "combined_score")
    p = F.when(F.col("event_count") % 11 != 0, (F.col("event_count") * 37 % 100) / 100 + 0.001)
    joined = rows.join(result, "attempt_id").withColumn("p_medium", p)
    return learning.refine_low_medium(joined).select("attempt_id", "refined_risk", "note", "used_p_medium")
