"""Streaming sources of ingest events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigilframe.schema import INGEST_EVENT


UNREADABLE = "_corrupt_record"


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON files of ingest events as they appear, stamped with the time of receipt.

    A line that is no event stays, as text in ``_corrupt_record``.
    """
    schema = StructType([*INGEST_EVENT.fields, StructField(UNREADABLE, StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", UNREADABLE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _stamped(reader.json(path))


def stream_events_parquet(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(INGEST_EVENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _stamped(reader.parquet(path))


def stream_events_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Ingest events as JSON values of a topic (needs the Kafka connector on the classpath)."""
    values = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    schema = StructType([*INGEST_EVENT.fields, StructField(UNREADABLE, StringType())])
    event = F.from_json(F.col("value").cast("string"), schema, {"columnNameOfCorruptRecord": UNREADABLE})
    return _stamped(values.select(event.alias("e")).select("e.*"))


def _stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("received_at", F.current_timestamp())
