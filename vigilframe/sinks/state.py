"""Keyed state kept as a log: a delta per version in hash buckets, compacted bucket by bucket.

A version writes the rows that it changes and nothing else; readers lay the deltas of a bucket over its base. A
bucket whose deltas have become many is written anew as a base, and only that bucket. What belongs to a version
is listed in its manifest, one small row per folder, written last: a version without manifest never was, and a
version that is repeated replaces its own folders. Lookups read the buckets of the wanted keys only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ENTRY = "kind string, made long, bucket int, schema string, expired string, buckets int"
BUCKET = "bucket"


def newest(rows: DataFrame, key: str, updated: str) -> DataFrame:
    """Last write wins per key; the rank limit is applied before the shuffle."""
    order = W.partitionBy(key).orderBy(F.col(updated).desc(), F.col("written_in").desc())
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class StateLog:
    """State rows by ``key``; of several rows of a key the one with the largest ``updated`` counts.

    ``buckets`` is fixed with the first version: set it so that a bucket's rows are some hundred MB. A bucket is compacted once it has ``longest`` deltas.
    """

    path: str
    key: str = "attempt_id"
    updated: str = "updated_at"
    buckets: int = 16
    longest: int = 8

    # ---- reading ----

    def manifest(self, spark: SparkSession, version: int) -> list | None:
        """The folders of a version, at most ``longest`` + 1 for each bucket; none if there is no such version."""
        try:
            return spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/version={version}").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self, spark: SparkSession, version: int, keys: DataFrame | None = None) -> DataFrame | None:
        """The state at a version, without what has expired; of ``keys`` only, if given. None if never written."""
        entries = self.manifest(spark, version)
        if entries is None:
            return None
        wanted = None
        if keys is not None:
            keys = keys.select(self.key).distinct()
            bucket = keys.select(self.bucket_of(entries[0].buckets).alias(BUCKET)).distinct()
            wanted = {r[BUCKET] for r in bucket.collect()}  # at most ``buckets`` numbers
        rows = self.rows_of(spark, entries, wanted)
        if keys is not None:
            rows = rows.join(keys, self.key, "left_semi")
        return self.living(newest(rows, self.key, self.updated), entries)

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def folders(self, entries: list) -> list[str]:
        return [f"{self.path}/rows/kind={e.kind}/made={e.made}/{BUCKET}={e.bucket}" for e in entries if e.kind != "none"]

    def rows_of(self, spark: SparkSession, entries: list, wanted: set | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entries[0].schema))
        found = self.folders([e for e in entries if wanted is None or e.bucket in wanted])
        if not found:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*found)
        return rows.select(*schema.names)

    def living(self, rows: DataFrame, entries: list) -> DataFrame:
        expired = entries[0].expired
        if expired is None:
            return rows
        return rows.where(F.col(self.updated) >= F.lit(expired).cast(rows.schema[self.updated].dataType))

    # ---- writing ----

    def upsert(self, changes: DataFrame, version: int, expired_before: Column | None = None) -> DataFrame:
        """Write the changes as the delta of a version on top of the version before."""
        spark = changes.sparkSession
        before = self.manifest(spark, version - 1) or []
        buckets = before[0].buckets if before else self.buckets
        fresh = newest(changes.withColumn("written_in", F.lit(version).cast("long")), self.key, self.updated)
        schema = _merged(before[0].schema if before else None, fresh.schema)
        expired = before[0].expired if before else None
        if expired_before is not None:
            kind = fresh.schema[self.updated].dataType
            row = spark.range(1).select(expired_before.cast(kind).cast("string").alias("at")).first()
            expired = row["at"] if row["at"] is not None else expired
        touched = self.write(fresh.withColumn(BUCKET, self.bucket_of(buckets)), "delta", version)
        held = {}
        for e in before:
            if e.kind != "none":
                held.setdefault(e.bucket, []).append((e.kind, e.made))
        for b in touched:
            held.setdefault(b, []).append(("delta", version))
        common = (schema.json(), expired, buckets)
        entries = _entries(held, common)
        full = {b for b in touched if len(held[b]) > self.longest}
        if expired is not None and len(held.get(version % buckets, [])) > 0:
            full.add(version % buckets)  # each bucket in its turn loses what has expired
        if full:
            merged = self.rows_of(spark, entries, full)
            merged = self.living(newest(merged, self.key, self.updated), entries)
            written = self.write(merged.withColumn(BUCKET, self.bucket_of(buckets)), "base", version)
            held.update({b: [("base", version)] if b in written else [] for b in full})
            entries = _entries(held, common)
        self.commit(spark, entries, version)
        return self.read(spark, version)

    def write(self, rows: DataFrame, kind: str, version: int) -> set[int]:
        """Rows as folders by bucket; the buckets that got any."""
        folder = f"{self.path}/rows/kind={kind}/made={version}"
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        files, path = _files(rows.sparkSession, folder)
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}

    def commit(self, spark: SparkSession, entries: list[tuple], version: int) -> None:
        rows = spark.createDataFrame([tuple(e) for e in entries], ENTRY).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def carry(self, spark: SparkSession, version: int) -> None:
        """A version without changes: the folders of the one before."""
        before = self.manifest(spark, version - 1)
        if before is not None:
            self.commit(spark, before, version)

    def drop_old(self, spark: SparkSession, before: int) -> None:
        """Remove the versions below ``before`` and the folders that no later version needs."""
        files, root = _files(spark, f"{self.path}/manifest")
        if not files.exists(root):
            return
        known = sorted(int(s.getPath().getName()[8:]) for s in files.listStatus(root) if s.getPath().getName().startswith("version="))
        needed = {f for v in known if v >= before for f in self.folders(self.manifest(spark, v))}
        for v in known:
            if v < before:
                files.delete(_files(spark, f"{self.path}/manifest/version={v}")[1], True)
        for kind in ("delta", "base"):
            of_kind = _files(spark, f"{self.path}/rows/kind={kind}")[1]
            for made in files.listStatus(of_kind) if files.exists(of_kind) else ():
                number = made.getPath().getName().removeprefix("made=")
                if int(number) >= before:
                    continue
                folder, buckets = f"{self.path}/rows/kind={kind}/made={number}", files.listStatus(made.getPath())
                names = {s.getPath().getName() for s in buckets if s.getPath().getName().startswith(f"{BUCKET}=")}
                gone = {n for n in names if f"{folder}/{n}" not in needed}
                for n in [""] if gone == names else gone:
                    files.delete(_files(spark, f"{folder}/{n}" if n else folder)[1], True)


class _Entry(tuple):
    kind, made, bucket, schema, expired, buckets = (property(lambda self, i=i: self[i]) for i in range(6))


def _entries(held: dict[int, list], common: tuple) -> list[_Entry]:
    found = [_Entry((kind, made, b, *common)) for b in sorted(held) for kind, made in held[b]]
    return found or [_Entry(("none", 0, 0, *common))]


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _merged(old: str | None, fresh: T.StructType) -> T.StructType:
    """Columns of before and new ones; all may be null."""
    fields = [T.StructField(f.name, f.dataType) for f in fresh.fields]
    if old is None:
        return T.StructType(fields)
    known = T.StructType.fromJson(json.loads(old))
    return T.StructType([*known.fields, *[f for f in fields if f.name not in known.names]])
