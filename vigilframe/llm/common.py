"""Tables, written intermediates, scattered running sums and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.session import cut, fresh_path

#: A word is a run of anything but these: space and the ASCII controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
BUCKET_BITS = 10
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later stages reread it, whatever executor is lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def map_texts(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` on rows with texts: batches are bounded by bytes, as some texts are very long."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows.mapInPandas(function, schema)


def word_count(text: str | Column) -> Column:
    """Words of a text; null and empty texts have none."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS)
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def group_key(column: str) -> Column:
    """A key that is never null: the null group gets a key that no value can have."""
    value = F.col(column).cast("string")
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value))


def hash_bucket(h: Column) -> Column:
    """The top bits of a 64-bit hash: buckets come in the order of the hash."""
    return F.shiftright(h, 64 - BUCKET_BITS).cast("int")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], amount: Column) -> DataFrame:
    """Adds ``before`` (sum of ``amount`` over the earlier rows of the group) and ``total`` (of the group).

    A group is ordered by ``bucket`` first. Sums run inside a (group, bucket); what the earlier buckets hold
    comes from one summary row per (group, bucket). So no task ever sees a whole group, only 1/1024 of it.
    """
    parts = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_part"))
    by = Window.partitionBy(*keys)
    ordered = by.orderBy(bucket)
    parts = parts.select(
        *keys,
        bucket,
        (F.sum("_part").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_part")).alias("_ahead"),
        F.sum("_part").over(by).alias("total"),
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_upto", F.sum(amount).over(inside) - amount)
    return (
        rows.join(parts, [*keys, bucket])
        .withColumn("before", F.col("_ahead") + F.col("_upto"))
        .drop("_ahead", "_upto")
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in the links (a, b): the smallest id that links reach.

    Alternating large-star and small-star steps: every step is a few aggregations and joins on one key, and
    every round's links are checkpointed. Ids without links are not listed.
    """
    now = cut(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    )
    state = _digest(now)
    while state[0]:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        now = cut(moved.unionByName(small.select(F.col("m").alias("lo"), "hi")).distinct())
        after = _digest(now)
        if after == state:
            break
        state = after
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component_id")).unionByName(
        now.select(F.col("lo").alias("id"), F.col("lo").alias("component_id")).distinct()
    )


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return row[0], row[1]
