"""Mixing, sharding and packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilframe.llm import shards
from vigilframe.llm.common import running
from vigilframe.llm.mixing import mix, mixed, sainte_lague
from vigilframe.llm.packing import pack, sequences
from vigilframe.llm.queries import QUERIES, byte_tokenizer
from vigilframe.llm.shards import document_shards, write_shards

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, shard int, size string, _key int"


def corpus(seed=2, n=300):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = None if i % 11 == 0 else "b" if i % 3 else f"s{i % 5}"
        text = None if i % 17 == 0 else "" if i % 19 == 0 else " ".join(f"w{x}" for x in draw.integers(0, 50, draw.integers(1, 90)))
        rows.append((i, text, source, 1, "x", 2))
    rows.append((1000, "long " * 30_000, "b", 1, "x", 2))
    return rows + [rows[5]] * 20  # repeated rows


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_sainte_lague_is_the_highest_quotients():
    draw = np.random.default_rng(4)
    for votes in ([1.0], [0.0, 0.0], [5.0, 5.0, 5.0], [1e9, 1.0, 3.0], *draw.uniform(0, 100, (20, 7)).tolist()):
        for seats in (0, 1, 2, 7, 50, 311):
            want = highest_quotients(votes, seats) if sum(votes) else [0] * len(votes)
            assert sainte_lague(np.array(votes), seats).tolist() == want


def targets_by_hand(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not above:
            return {**target, **share}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixture(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mix(docs, keep=("source",)).collect()
    assert len(found) == len(rows)
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == sum(s.words for s in r.spans) <= 2 * r["size"]
        assert all(0 <= s.start and s.start + s.words <= r["size"] and 0 <= s.shard < 16 for s in r.spans)
        assert len({(s["pass"], w) for s in r.spans for w in range(s.start, s.start + s.words)}) == r.taken
    want = targets_by_hand(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mix(docs.repartition(5), keep=("source",)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_mixture_of_very_many_sources(spark):
    n = 200_100
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('s', id) AS source", "repeat('w ', int(1 + id % 3)) AS text")
    found = mix(rows.repartition(4), keep=("source",)).toPandas().sort_values("source", key=lambda s: s.map(str.encode))
    assert len(found) == n
    votes, sizes = found["target"].to_numpy(), found["size"].to_numpy()
    assert abs(votes.sum() - 1.5 * sizes.sum()) < 1e-3
    # quotients of the first seats, ties to the source that comes first; a seat is a word
    quotients = np.concatenate([votes / (2 * k + 1) for k in range(9)])
    order = np.lexsort((np.tile(np.arange(n), 9), -quotients))[: round(votes.sum())]
    won = np.bincount(order % n, minlength=n)
    assert (found["taken"].to_numpy() == np.minimum(won, 2 * sizes)).all()


@pytest.mark.parametrize("sources,words", [(1000, 10), (100, 33), (40, None)])
def test_small_sources_meet_their_targets(spark, sources, words):
    """Sources of 1 to 10,000 words, in documents of any size."""
    size = lambda i: words or int(10 ** (i / (sources - 1) * 4))
    rows = [(f"s{i}", j) for i in range(sources) for j in (size(i) // 3, size(i) - size(i) // 3)]
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    found = mix(docs, keep=("source",)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n"))
    for r in found.collect():
        assert abs(r.taken - r.target) <= max(1, 0.01 * r.target) and r.n == size(int(r.source[1:])), r


def test_mixture_itself(spark):
    rows = corpus() + [(2000 + i, f" \t{' '.join(f'x{j}' for j in range(99))}\n\nLast  line. ", "b", 1, "x", 2) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixed(docs).collect()
    texts = {i: t for i, t, *_ in rows}
    taken = {r.doc_id: 0 for r in found}
    for r in found:
        taken[r.doc_id] += len(r.text.split())
        assert r.text in texts[r.doc_id] and (r.text == texts[r.doc_id] or r.text == r.text.strip())
    want = {}
    for r in mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v}
    assert mixed(docs).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none).collect() == [] and mixed(none).collect() == []
    assert document_shards(none).collect() == []
    assert pack(none, **byte_tokenizer()).collect() == []
    blank = spark.createDataFrame([(1, None, None, 1, "", 1), (2, "", "a", 1, "", 1)], SCHEMA)
    assert [r.taken for r in mix(blank).collect()] == [0, 0]


def check_shards(rows, found):
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in found) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = document_shards(docs)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_shards(rows, found.collect())
    again = document_shards(docs.repartition(7))
    assert sorted(tuple(r)[:6] for r in found.collect()) == sorted(tuple(r)[:6] for r in again.collect())
    write_shards(found, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_every_shard_follows_the_mixture(spark):
    rows = [(i, "t", "abcd"[min(3, i % 7)], 1, "", 1) for i in range(1600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    joined = document_shards(docs).join(docs.select("doc_id", "source"), "doc_id")
    counts = {}
    for r in joined.groupBy("shard", "source").count().collect():
        counts.setdefault(r.source, []).append(r["count"])
    assert all(len(v) == 16 and max(v) - min(v) <= 2 for v in counts.values())


def test_small_sources_spread_over_the_slices(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(shards, "running", lambda df, *a: calls.append(df) or running(df, *a))
    rows = [(i, "t", f"s{i}", 1, "", 1) for i in range(3000)]
    check_shards(rows, document_shards(spark.createDataFrame(rows, SCHEMA)).collect())
    assert calls[1].groupBy("_slice").count().agg(F.max("count")).first()[0] < 20


def check_pieces(rows, pieces):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    copies = {i: sum(1 for r in rows if r[0] == i) for i in ids}
    total = 0
    places, covered = {}, {}
    for p in pieces:
        own = ids[p.doc_id]
        assert zlib.crc32(own[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.length > 0
        assert p.doc_tokens == len(own)
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
        total += p.length
    assert covered == {i: len(v) * copies[i] for i, v in ids.items()}
    for s, parts in places.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or s == max(places)
    assert sorted(places) == list(range(-(-total // 2048)))


def test_pieces(spark):
    rows = corpus() + [(2000, "a<|endoftext|>b", "b", 1, "", 1), (2001, "x" * 5000, "b", 1, "", 1), (2002, "🙂é　\t\x00", "b", 1, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = pack(docs, **byte_tokenizer())
    check_pieces(rows, pieces.collect())
    whole = sequences(pieces).collect()
    assert all(len(r.ids) == 2048 for r in whole)
    assert sum(r.n for r in whole) == pieces.agg(F.sum("length")).first()[0]


def test_long_white_space(spark):
    blanks = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    runs = [" " * 1_100_000, blanks * 70_000, " \x1c" * 60_000]
    texts = [t for run in runs for t in (run, f"it's{run}1 {run}\n! ")]
    rows = [(i, t, "b", 1, "", 1) for i, t in enumerate([*texts, " " * 100_000 + "a", " " * 100_001 + "a", " " * 100_001 + "\n"])]
    docs = spark.sparkContext.parallelize(rows, len(rows)).toDF(SCHEMA)
    check_pieces(rows, pack(docs, **byte_tokenizer()).collect())


def test_queries_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(rows, QUERIES["op5_packing"](spark, SF).collect())
    check_shards(rows, QUERIES["op4_sharding"](spark, SF).collect())
    found = QUERIES["op3_mixing"](spark, SF).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in found)
    size = {i: len((t or "").encode().split()) for i, t in rows}
    assert {r.doc_id: r["size"] for r in found} == size
