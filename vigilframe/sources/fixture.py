"""The assessment view of the generic ``events`` table, used by the registered queries.

An hour of the table becomes a second of assessment time (four times faster for every fourth
user), a user's week becomes an attempt, and event types map to browser telemetry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
WEEK_US = 7 * 86_400_000_000


def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    src = (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select(
            "event_id",
            "user_id",
            F.col("event_type").alias("src"),
            us.alias("us"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )
        .withColumn("co", F.col("user_id") % 4)
    )
    src_is = lambda name: F.col("src") == name
    digit = F.col("k") % 10
    co0, co1 = F.col("co") == 0, F.col("co") == 1
    user = F.col("user_id").cast("string")
    named = F.col("user_id") % 7 != 0
    hidden_below = F.when(co0, 8).when(co1, 3).otherwise(4)
    idle_row = src_is("signup") & (digit < 8)
    return src.select(
        F.concat_ws("-", user, F.when(co1, F.lit(0)).otherwise(F.expr(f"us div {WEEK_US}")).cast("string")).alias(
            "attempt_id"
        ),
        F.when(src_is("view") | (src_is("click") & (digit < 7)), "question_view")
        .when(src_is("click"), "question_answer")
        .when(src_is("purchase"), "clipboard")
        .when(src_is("error"), "visibility_change")
        .when(idle_row, "idle_state")
        .when(digit == 8, "exam_started")
        .otherwise("exam_submitted")
        .alias("event_type"),
        F.when(src_is("view"), "enter")
        .when(src_is("click") & (digit < 7), "leave")
        .when(src_is("purchase"), F.when(~co1 & (F.col("k") % 2 == 0), "paste").otherwise("copy"))
        .alias("action"),
        F.when(src_is("error"), F.when(digit < hidden_below, "hidden").otherwise("visible"))
        .when(idle_row, F.when(F.col("k") % 2 == 0, "idle").otherwise("active"))
        .alias("state"),
        F.concat(F.lit("q"), (F.col("k") % 5 + 1).cast("string")).alias("question_id"),
        F.expr("us div CASE WHEN co = 0 THEN 14400 ELSE 3600 END").alias("t_us"),
        F.col("event_id").alias("client_seq"),
        F.col("event_id").alias("arrival"),
        (F.col("us") + F.lit(EPOCH_US)).alias("received_us"),
        "k",
        F.concat(F.lit("candidate_"), user).alias("candidate_id"),
        F.when(named, F.concat(F.lit("Candidate "), user)).alias("candidate_name"),
        F.when(named, F.concat(F.lit("c"), user, F.lit("@example.org"))).alias("candidate_email"),
        F.concat(F.lit("assessment_"), (F.col("user_id") % 3).cast("string")).alias("assessment_id"),
        F.concat(F.lit("Assessment "), (F.col("user_id") % 3).cast("string")).alias("assessment_name"),
        F.when(co0, "HIGH").when(co1, "MEDIUM").otherwise("LOW").alias("expected_label"),
        (F.col("user_id") % 10 == 0).alias("is_edge_case"),
        F.concat(F.lit("profile_"), (F.col("user_id") % 10).cast("string")).alias("profile"),
    )


def iso_time(t_us: str):
    """Micros since the epoch above as ISO text with Z, whatever the session zone is."""
    at = F.expr(f"cast(timestampadd(MICROSECOND, {t_us}, TIMESTAMP_NTZ'2024-01-01 00:00:00') as string)")
    return F.concat(F.replace(at, F.lit(" "), F.lit("T")), F.lit("Z"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked arrivals with text times and JSON payloads; some rows are broken on purpose."""
    k = F.col("k")
    return attempt_events(spark, sf_dir).select(
        F.col("arrival").alias("id"),
        "attempt_id",
        F.when(
            (k == 96) & F.col("attempt_id").startswith("1"), F.concat(F.col("attempt_id"), F.lit("-other"))
        )
        .when(k % 3 == 0, F.col("attempt_id"))
        .alias("event_attempt_id"),
        "candidate_id",
        "candidate_name",
        "candidate_email",
        "assessment_id",
        "assessment_name",
        F.when(k != 97, F.col("event_type")).alias("event_type"),
        F.to_json(F.struct("action", "state", "question_id")).alias("payload"),
        F.when(k == 98, F.lit("not a time")).when(k != 99, iso_time("t_us")).alias("occurred_at"),
        F.when(k % 4 != 0, F.col("client_seq").cast("string")).alias("client_seq"),
        iso_time(f"received_us - {EPOCH_US}").alias("received_at"),
        "arrival",
    )
