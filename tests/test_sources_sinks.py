import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from vigilframe.operators import evaluate, learning
from vigilframe.session import fresh_path, shared_dir
from vigilframe.sinks import writers
from vigilframe.sources import readers


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_batches_keep_arrival_order_and_unknown_keys(spark, tmp_path):
    batch = {
        "attempt_id": "a",
        "events": [
            {"event_type": "clipboard", "occurred_at": "2024-01-01T00:00:02Z", "payload": {"action": "paste", "device": "pen"}, "client_seq": 4},
            {"event_type": "focus", "occurred_at": "2024-01-01T00:00:01Z", "attempt_id": "a"},
        ],
    }
    path = write_lines(tmp_path / "b.json", [json.dumps(batch), json.dumps({"attempt_id": "empty", "events": []})])
    rows = readers.scan_attempt_batches(spark, path)
    got = rows.where("attempt_id = 'a'").orderBy("arrival").collect()
    assert [(r.event_type, r.client_seq) for r in got] == [("clipboard", "4"), ("focus", None)]
    assert rows.where("attempt_id = 'empty'").count() == 1
    lifted = readers.lift_payload(rows.where("client_seq = 4")).first()
    assert lifted.payload_fields.action == "paste" and lifted.payload_rest == {"device": "pen"}


def test_arrival_follows_files_and_offsets_whatever_order_they_are_read_in(spark, tmp_path):
    """Small files first, splits of a few lines, records that go on in later files, one that is far longer than a split."""
    event = lambda n: {"event_type": "focus", "occurred_at": "2024-01-01T00:00:01Z", "client_seq": str(n)}
    number, folder = iter(range(10**6)), tmp_path / "in"
    folder.mkdir()
    for name, sizes in (("a b", [1]), ("b", [3, 1, 400, 2] * 5), ("c", []), ("d", [1] * 300), ("e", [2])):
        lines = [json.dumps({"attempt_id": "x", "events": [event(next(number)) for _ in range(n)]}) for n in sizes]
        write_lines(folder / f"{name}.json", lines)
    total = next(number)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(k) for k in keys]
    try:
        for sizes in (("700b", "700"), ("3kb", "64MB"), kept):
            for key, size in zip(keys, sizes):
                spark.conf.set(key, size)
            rows = readers.scan_attempt_batches(spark, str(folder))
            got = [int(r.client_seq) for r in rows.select("client_seq", "arrival").orderBy("arrival").collect()]
            assert got == list(range(total)), sizes
            assert rows.select("arrival").distinct().count() == total
        found = readers.labelled_attempts(spark, str(folder)).first()
        assert (found.n_events, found.first_event.client_seq, found.expected_label) == (total, "0", None)
    finally:
        for key, size in zip(keys, kept):
            spark.conf.set(key, size)


def test_score_log_skips_bad_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T10:00:00", "attempt_id": "a", "risk": "LOW", "confidence": 0.5, "features": {"paste_count": 1}}
    lines = [json.dumps(good), "{broken", json.dumps({"risk": "LOW"}), json.dumps({"features": {}}), "",
             json.dumps({**good, "attempt_id": "b", "confidence": "n/a", "timestamp": "never"})]
    log = readers.coerce_log_types(readers.scan_score_log(spark, write_lines(tmp_path / "log.jsonl", lines)))
    got = {r.attempt_id: r for r in log.collect()}
    assert sorted(got) == ["a", "b"]
    assert got["a"].confidence == 0.5 and got["b"].confidence == 0.0 and got["b"].timestamp is None
    assert got["a"].combined_score == 0.0


def test_labelled_attempts_fail_on_bad_json(spark, tmp_path):
    good = json.dumps({"attempt_id": "a", "expected_label": "LOW", "events": []})
    ok = readers.scan_labelled_attempts(spark, write_lines(tmp_path / "ok.jsonl", [good, "", good]))
    assert ok.count() == 2
    bad = readers.scan_labelled_attempts(spark, write_lines(tmp_path / "bad.jsonl", [good, "{oops"]))
    with pytest.raises(Exception):
        bad.collect()


def test_raw_table_is_partitioned_and_filters_reach_the_files(spark):
    path = fresh_path(spark, "t_raw")
    rows = spark.range(100).select(
        F.col("id"), F.concat(F.lit("a"), F.col("id") % 5).alias("attempt_id"),
        *[F.lit("x").alias(c) for c in ("candidate_id", "candidate_name", "candidate_email", "assessment_id", "assessment_name", "event_type", "payload")],
        F.lit("2024-01-01T00:00:00Z").alias("occurred_at"),
        F.when(F.col("id") < 50, "2024-01-01T09:00:00Z").otherwise("2024-01-02T09:00:00Z").alias("received_at"),
    )
    writers.append_raw_events(rows, path)
    table = readers.scan_raw_events(spark, path)
    assert table.select("event_date").distinct().count() == 2
    plan = readers.events_for_attempt(table.where("event_date = '2024-01-01'"), "a3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attempt_id,a3)" in plan and "PartitionFilters: [isnotnull(event_date" in plan


def test_one_attempt_is_found_in_its_folders(spark):
    path = fresh_path(spark, "t_folders")
    rows = spark.range(4000).select(
        F.concat(F.lit("a"), F.col("id") % 200).alias("attempt_id"), "id", F.lit("x").alias("event_type"),
        F.col("id").cast("string").alias("occurred_at"), F.lit("2024-01-01T09:00:00Z").alias("received_at"))
    writers.append_raw_events(rows.unionByName(rows.limit(3).withColumn("attempt_id", F.lit(None).cast("string"))), path, digits=2)
    table = spark.read.parquet(path)
    assert table.count() == 4003
    mine = readers.of_attempt(table, "a17")
    assert sorted(r.id for r in mine.collect()) == list(range(17, 4000, 200))
    scan = mine._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() <= writers.SPREAD < len(table.inputFiles())
    assert readers.of_attempt(table, "none").isEmpty()


def test_state_upsert_is_last_write_wins_and_repeatable(spark):
    path = fresh_path(spark, "t_state")
    rows = lambda *r: spark.createDataFrame(r, "attempt_id string, risk string, updated_at long")
    writers.upsert_current_risk(rows(("a", "LOW", 1), ("b", "LOW", 1)), path, 0)
    for _ in range(2):  # the repeated version replaces itself
        state = writers.upsert_current_risk(rows(("a", "HIGH", 5), ("c", "LOW", 2)), path, 1)
        assert {(r.attempt_id, r.risk) for r in state.collect()} == {("a", "HIGH"), ("b", "LOW"), ("c", "LOW")}
    writers.carry_current_risk(spark, path, 2)
    live = writers.upsert_current_risk(rows(("d", "LOW", 9)), path, 3, expired_before=F.lit(2))
    assert {r.attempt_id for r in live.collect()} == {"a", "c", "d"}


def test_history_batches_replace_themselves(spark):
    path = fresh_path(spark, "t_history")
    rows = spark.createDataFrame([("a", "LOW"), ("b", "HIGH")], "attempt_id string, risk string")
    for batch in (0, 1, 1):
        writers.append_risk_history(rows, path, batch)
    assert spark.read.parquet(path).count() == 4


def test_training_csv_round_trip(spark):
    path = fresh_path(spark, "t_csv")
    names = learning.REFINE_COLUMNS
    rows = spark.range(3).select(F.lit("LOW").alias("label"), *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(names)])
    writers.write_training_csv(rows, path, "label", names)
    back = readers.scan_training_csv(spark, path, "label", names)
    assert back.columns == ["label", *names] and same_rows(back, rows)


def same_rows(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_report_files(spark):
    path = fresh_path(spark, "t_report")
    pairs = spark.createDataFrame([("LOW", "LOW"), ("LOW", "HIGH"), ("HIGH", "HIGH")], "expected_label string, predicted_label string")
    writers.write_eval_report(evaluate.eval_metrics(pairs), evaluate.confusion_with_totals(pairs), path)
    m = spark.read.json(f"{path}/metrics").first()
    assert m.n_attempts == 3 and m.false_positive_rate == 0.5 and m.high_recall == 1.0 and m.medium_recall == 0.0
    total = spark.read.option("header", True).csv(f"{path}/confusion").where("expected_label = 'TOTAL'").first()
    assert (total.LOW, total.HIGH, total.total) == ("1", "2", "3")


def test_empty_evaluation_gives_zeros(spark):
    none = spark.createDataFrame([], "expected_label string, predicted_label string")
    assert evaluate.eval_metrics(none).first().accuracy == 0.0
    assert evaluate.confusion_matrix(none).count() == 3
    assert evaluate.classification_report(none).where("label = 'macro avg'").first().f1_score == 0.0


def test_shared_dir_is_the_one_of_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert SMALL.startswith("/root/testdata")
