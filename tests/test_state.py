"""The state log: deltas, compaction, replay, expiry, lookups."""

import glob
import os

from pyspark.sql import functions as F

from vigilframe.session import fresh_path
from vigilframe.sinks.state import StateLog


def rows(spark, values, at):
    return spark.createDataFrame([(f"a{i}", v, at) for i, v in values], "attempt_id string, value int, updated_at long")


def content(df):
    return {r.attempt_id: (r.value, r.updated_at) for r in df.collect()}


def files(log):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{log.path}/rows/**/*.parquet", recursive=True)}


def test_a_version_writes_what_it_changes(spark):
    log = StateLog(fresh_path(spark, "t_log"), buckets=100, longest=3)
    want = {f"a{i}": (0, 0) for i in range(3000)}
    assert content(log.upsert(rows(spark, [(i, 0) for i in range(3000)], 0), 0)) == want
    whole = files(log)
    assert len(whole) == 100
    for version in range(1, 6):  # the same key every time: one bucket of a hundred
        found = log.upsert(rows(spark, [(7, version)], version), version)
        want["a7"] = (version, version)
        assert content(found) == want
    after = files(log)
    assert all(after[f] == t for f, t in whole.items())
    assert len(after) - len(whole) <= 7
    entries = log.manifest(spark, 5)
    assert max(sum(e.bucket == b for e in entries) for b in range(100)) <= 3


def test_a_repeated_version_changes_nothing(spark):
    log = StateLog(fresh_path(spark, "t_log"), buckets=4, longest=2)
    for version in range(6):
        for _ in range(2):
            found = log.upsert(rows(spark, [(i, version) for i in range(version, 8)], version), version)
    want = {f"a{i}": (min(i, 5), min(i, 5)) for i in range(8)}
    assert content(found) == want and content(log.read(spark, 5)) == want
    log.carry(spark, 6)
    assert content(log.read(spark, 6)) == want
    log.drop_old(spark, 5)
    assert log.read(spark, 4) is None and content(log.read(spark, 5)) == want
    kept = set(log.folders(log.manifest(spark, 5)) + log.folders(log.manifest(spark, 6)))
    assert {f.split("/rows/")[1] for f in kept} == {os.path.dirname(f).split("/rows/")[1] for f in files(log)}


def test_older_changes_lose_and_the_expired_go(spark):
    log = StateLog(fresh_path(spark, "t_log"), buckets=3)
    log.upsert(rows(spark, [(1, 1), (2, 2)], 10), 0)
    assert content(log.upsert(rows(spark, [(1, 9), (3, 3)], 5), 1)) == {"a1": (1, 10), "a2": (2, 10), "a3": (3, 5)}
    assert content(log.upsert(rows(spark, [(4, 4)], 20), 2, F.lit(10))) == {"a1": (1, 10), "a2": (2, 10), "a4": (4, 20)}
    for version in range(3, 6):  # every bucket has had its turn
        found = log.upsert(rows(spark, [(5, 5)], 30), version, F.lit(25))
    assert content(found) == {"a5": (5, 30)}
    assert log.rows_of(spark, log.manifest(spark, 5)).count() <= 3


def test_lookups_read_the_buckets_of_their_keys(spark):
    log = StateLog(fresh_path(spark, "t_log"), buckets=50)
    log.upsert(rows(spark, [(i, i) for i in range(500)], 1), 0)
    found = log.read(spark, 0, rows(spark, [(3, 0), (9999, 0)], 0))
    assert content(found) == {"a3": (3, 1)}
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) <= 2
    assert log.read(spark, 1) is None


def test_new_columns_and_no_rows(spark):
    log = StateLog(fresh_path(spark, "t_log"), buckets=2)
    assert log.upsert(rows(spark, [], 0), 0).collect() == []
    log.upsert(rows(spark, [(1, 1)], 1), 1)
    found = log.upsert(rows(spark, [(2, 2)], 1).withColumn("more", F.lit("x")), 2)
    assert {(r.attempt_id, r.more) for r in found.collect()} == {("a1", None), ("a2", "x")}
