"""Proportional stratified interleaving into shards, DataFrame functions only.

Rows of a source are put in a seeded order; row r of n gets the place (r - 1 + u) / n, where u in (0, 1) is
drawn per source, so that small sources spread over all places. All rows sorted by place follow the mixture
everywhere, so consecutive cuts of equal length give shards that match it.

Both orders are found without a sort of everything in one place: a rank is the rank inside a bucket (of the
hash, or of the place) plus the rows of the earlier buckets, from one summary row per bucket.

Defined cases: null sources are one source; a null text has size 1 and the checksum of the empty text;
repeated rows each get a slot of their own; rows that are alike in id, source and text can change places;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import group_key, hash_bucket, running, written

PLACES = 1024


def interleave(
    docs: DataFrame, shards: int = 16, seed: int = 0, source: str = "source", order_by=("doc_id",)
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Numbers of rows of any two shards differ by one at most. All columns go through two shuffles: give narrow
    rows (ids and digests) and join the rest afterwards where rows are wide.
    """
    own = docs.columns
    tie = [F.col(f"_in.{c}") for c in order_by]
    rows = docs.select(F.struct(*own).alias("_in"), group_key(source).alias("_key"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *tie)).withColumn("_bucket", hash_bucket(F.col("_h")))
    rows = written(rows, "shard-rows")
    ranked = running(rows, ["_key"], "_bucket", [F.col("_h"), *tie], F.lit(1))
    offset = (F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    ranked = written(
        ranked.withColumn("_place", (F.col("before") + offset) / F.col("total"))
        .withColumn("_slice", F.floor(F.col("_place") * PLACES).cast("int"))
        .withColumn("_all", F.lit(0))
        .drop("before", "total", "_bucket"),
        "shard-places",
    )
    order = [F.col("_place"), F.xxhash64(F.lit(seed), "_key"), F.col("_key"), F.col("_h"), *tie]
    placed = running(ranked, ["_all"], "_slice", order, F.lit(1))
    placed = placed.withColumn("shard", F.expr(f"int(before * {shards} div total)"))
    slot = F.expr(f"before - (shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("slot", slot.cast("long")).select("_in.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = interleave(rows, shards, seed, order_by=("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
