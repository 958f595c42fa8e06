"""Batch sources. Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.schema import (
    ATTEMPT_BATCH,
    ATTEMPT_BUCKET,
    IDENTITY,
    LABELLED_ATTEMPT,
    PAYLOAD,
    RAW_EVENT_COLUMNS,
    SCORE_LOG,
    in_bucket_of,
)

_BAD = "_corrupt_record"
_LABEL_FIELDS = ("expected_label", "candidate", "assessment", "profile", "is_edge_case", "edge_case_scenario")
#: Bits of Spark's row numbers inside a task.
_ROW_BITS = 33
#: File names are broadcast up to this number.
BROADCAST_FILES = 200_000


def scan_attempt_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of attempt batches, one row per event in order of arrival.

    ``arrival`` follows file names, then the order in the file, whatever order Spark reads in. So an attempt of any
    length may be several records of bounded size, in several files.
    """
    batches = spark.read.schema(ATTEMPT_BATCH).json(path)
    rows = batches.select("*", "_metadata.file_path", "_metadata.file_block_start")
    events = rows.select("attempt_id", "file_path", "file_block_start", F.explode_outer("events").alias("_e"))
    return _event_columns(_in_file_order(spark, events, path))


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per event of batches that come from no files. ``arrival`` numbers all rows in the order of reading,
    so it is unique, and the events of one record are in their order."""
    events = batches.select("attempt_id", F.explode_outer("events").alias("_e"))
    return _event_columns(events.withColumn("arrival", F.monotonically_increasing_id()))


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "attempt_id",
        F.col("_e.attempt_id").alias("event_attempt_id"),
        "_e.event_type",
        "_e.occurred_at",
        "_e.payload",
        "_e.client_seq",
        "arrival",
    )


def _split_unit(spark: SparkSession) -> int:
    """A length in bytes that no split of a file falls below, but for the last one of the file."""
    units = {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40, "p": 2**50}
    found = [2**20]
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)b?\s*", spark.conf.get(key).lower()).groups()
        found.append(int(number) * units[unit])
    return max(1, min(found))


def _in_file_order(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Adds ``arrival`` to rows that carry ``file_path`` and ``file_block_start``.

    Spark packs splits of files into tasks by size, so its row numbers follow no file order; inside a split they do.
    The high bits of ``arrival`` number the splits by file name and offset, the low ones are the row number in the task.
    Names and sizes of the files are listed without their content; settings of split sizes must not be lowered
    between this call and the run.
    """
    unit = _split_unit(spark)
    # a folder's files only: the content column is not read
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size")
    blocks = F.expr(f"file_size div {unit} + 1")
    # one narrow row per file
    upto = W.orderBy("file_path").rowsBetween(W.unboundedPreceding, 0)
    files = files.select("file_path", (F.sum(blocks).over(upto) - blocks).alias("_first"))
    if files.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        files = F.broadcast(files)
    block = F.col("_first") + F.expr(f"file_block_start div {unit}")
    row = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).join(files, "file_path")
    numbered = F.when(
        block < F.lit(1 << (63 - _ROW_BITS)), F.shiftleft(block, _ROW_BITS).bitwiseOR(row)
    ).otherwise(F.raise_error(F.lit("too many file splits for one order of arrival")))
    return rows.withColumn("arrival", numbered.cast("long")).drop("_row", "_first", "file_path", "file_block_start")


def scan_raw_events(spark: SparkSession, path: str) -> DataFrame:
    """The raw event table; filters on attempt or date reach the files."""
    return spark.read.parquet(path)


def scan_raw_events_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """The raw event table of a database, read in parallel when partition options are given."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def scoring_events(raw: DataFrame) -> DataFrame:
    """The columns of raw events that scoring needs; an absent payload is an empty one."""
    seq = F.col("client_seq") if "client_seq" in raw.columns else F.lit(None).cast("string")
    return raw.select(
        "attempt_id",
        F.lit(None).cast("string").alias("event_attempt_id"),
        "event_type",
        F.coalesce("payload", F.lit("{}")).alias("payload"),
        "occurred_at",
        seq.alias("client_seq"),
        F.col("id").cast("long").alias("arrival"),
    )


def scan_score_log(spark: SparkSession, path: str) -> DataFrame:
    """Score log lines; unreadable ones and those without features or risk are skipped."""
    schema = T.StructType([*SCORE_LOG.fields, T.StructField(_BAD, T.StringType())])
    lines = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .json(path)
    )
    return lines.where(f"{_BAD} IS NULL AND features IS NOT NULL AND risk IS NOT NULL").drop(_BAD)


def coerce_log_types(log: DataFrame) -> DataFrame:
    """Times that cannot be read become null, numbers that cannot be read become 0."""
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(0.0))
    return log.withColumns(
        {
            "timestamp": F.try_to_timestamp(F.col("timestamp")),
            **{c: number(c) for c in ("confidence", "confidence_score", "combined_score")},
        }
    )


def scan_labelled_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Labelled attempts; a malformed line fails the read, blank lines are skipped."""
    return spark.read.schema(LABELLED_ATTEMPT).option("mode", "FAILFAST").json(path)


def labelled_attempts(spark: SparkSession, path: str) -> DataFrame:
    """One row per labelled attempt, whose events may be spread over several records.

    Of each field the first record (in file order) that has it counts; events are counted, the first one is shown.
    """
    records = scan_labelled_attempts(spark, path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    narrow = records.select(
        "attempt_id",
        *_LABEL_FIELDS,
        F.coalesce(F.size("events"), F.lit(0)).alias("_n"),
        F.try_element_at("events", F.lit(1)).alias("_first_event"),
        "file_path",
        "file_block_start",
    )
    rows = _in_file_order(spark, narrow, path)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival")))
    return rows.groupBy("attempt_id").agg(
        *[first(c).alias(c) for c in _LABEL_FIELDS],
        F.sum(F.greatest("_n", F.lit(0))).cast("long").alias("n_events"),
        first("_first_event").alias("first_event"),
    )


def scan_training_csv(spark: SparkSession, path: str, label: str, features: Sequence[str]) -> DataFrame:
    """Training rows with a header; feature values that are not numbers become 0."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (label, *features)])
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)).alias(c)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(label, *[number(c) for c in features])


def of_attempt(table: DataFrame, attempt_id: str) -> DataFrame:
    """Rows of one attempt; of a table in folders by attempt only its folders are read."""
    mine = table.where(F.col("attempt_id") == attempt_id)
    return mine.where(in_bucket_of(attempt_id)) if ATTEMPT_BUCKET in table.columns else mine


def events_for_attempt(raw: DataFrame, attempt_id: str) -> DataFrame:
    """Raw events of one attempt by event time (text order)."""
    mine = of_attempt(raw, attempt_id)
    return mine.select(*RAW_EVENT_COLUMNS).orderBy("occurred_at", "id")


def risk_history_for_attempt(history: DataFrame, attempt_id: str, time: str = "timestamp") -> DataFrame:
    columns = [c for c in ("id", "attempt_id", *IDENTITY, "risk", "confidence", "combined_score", "reason", time) if c in history.columns]
    return history.where(F.col("attempt_id") == attempt_id).select(*columns).orderBy(time)


def lift_payload(events: DataFrame) -> DataFrame:
    """Known payload keys as a struct column, all others in a map."""
    known = F.array(*[F.lit(f.name) for f in PAYLOAD.fields])
    everything = F.from_json("payload", "map<string,string>")
    return events.withColumns(
        {
            "payload_fields": F.from_json("payload", PAYLOAD),
            "payload_rest": F.map_filter(everything, lambda k, v: ~F.array_contains(known, k)),
        }
    )
