import numpy as np
import pytest

from vigilframe.llm import topk
from vigilframe.llm.queries import QUERIES
from vigilframe.llm.topk import search_block, top_k, usable
from vigilframe.llm.vector_dedup import near_vectors
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, cells string"


def vectors(seed=3, centres=6, copies=40, dim=24):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        centre = draw.standard_normal(dim)
        for _ in range(copies):
            out.append(centre + draw.standard_normal(dim) * draw.choice([0.0, 0.1, 0.25, 0.4]))
    return [(i, [float(x) for x in v], 0, "u", "c") for i, v in enumerate(np.array(out, dtype=np.float32))]


ODD = [
    (900, None, 1, None, None),
    (901, [], 1, None, None),
    (902, [0.0] * 24, 1, None, None),
    (903, [float("nan")] * 24, 1, None, None),
    (904, [float("inf")] + [1.0] * 23, 1, None, None),
    (905, [None] + [1.0] * 23, 1, None, None),
    (906, [1.0, 2.0], 1, None, None),
    (907, [2.0, 4.0], 1, None, None),
    (908, [1e30] * 24, 1, None, None),
    (909, [1e30] * 24, 1, None, None),
]


def linkable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if linkable(v)]
    links = {i: set() for i, *_ in rows}
    for x, (i, v) in enumerate(good):
        for j, w in good[x + 1 :]:
            if len(v) == len(w):
                v1, w1 = v / np.abs(v).max(), w / np.abs(w).max()
                if v1 @ w1 / np.sqrt((v1 @ v1) * (w1 @ w1)) >= 0.95:
                    links[i].add(j)
                    links[j].add(i)
    least = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += links[k]
    return {i: (len(links[i]), least[i], least[i] == i) for i in links}


def test_links_and_components(spark):
    rows = vectors() + ODD
    found = near_vectors(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute_links(rows)


def test_repeated_vectors_count_each(spark):
    rows = [(7, [1.0, 0.0], 0, "", ""), (7, [1.0, 0.0], 0, "", ""), (3, [1.0, 0.1], 0, "", "")]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(3, 2, 3), (7, 2, 3), (7, 2, 3)]


@pytest.mark.parametrize("operator", [near_vectors, lambda v: top_k(v, F.col("vec_id") % 50 == 0)])
def test_no_vectors(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in good:
        if i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v)]
            out |= {(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(sorted(scores)[:k])}
    return out


def test_top_k(spark):
    rows = [r for r in vectors(5, 8, 40) + ODD if r[0] not in (908, 909)]
    rows += [(1000, rows[3][1], 0, "", ""), (1050, rows[3][1], 0, "", ""), (1050, rows[3][1], 0, "", ""), (1100, [1.0, 0.5], 0, "", "")]
    found = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in found} == brute_top(rows[:-3] + rows[-2:])
    assert len(found) == len({(r.query_id, r["rank"]) for r in found})


def test_lengths_outside_the_sample_have_pivots(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOT_SAMPLE", 1)
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=3 + i % 4).tolist()) for i in range(400)] + [(450, []), (500, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(docs, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in found} == brute_top(rows)
    ints = docs.select("vec_id", topk.whole(F.col("embedding")).alias("ints"))
    # one length has its pivots from a sample of one row
    counted = {r.dim: len(r.distances) for r in topk.pivot_table(ints).collect()}
    assert counted.pop(0) == 0 and sorted(counted) == [3, 4, 5, 6]
    assert sorted(counted.values()) in ([1] + 3 * [topk.PIVOTS], 4 * [topk.PIVOTS])


def test_search_stops_exactly():
    import pandas as pd

    draw = np.random.default_rng(1)
    ints = draw.integers(-9, 9, (700, 4))
    pivots = ints[:3].astype(float)
    frame = pd.DataFrame({"vec_id": np.arange(700), "ints": list(ints)})
    frame["square"] = [float(x @ x) for x in ints]
    frame["distances"] = [np.linalg.norm(pivots - x, axis=1) for x in ints]
    frame["uid"] = frame["vec_id"]
    got = search_block(frame[:20], frame, 5)
    for q, part in got.groupby("query_id"):
        order = sorted((-int(ints[q] @ x), i) for i, x in enumerate(ints) if i != q)[:5]
        assert [(-s, i) for s, i in order] == list(zip(part["score"], part["vec_id"]))


def test_very_large_numbers_are_exact(spark):
    rows = [(0, [3e15, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1e17]), (3, [1e30, 0.0])]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3)
    whole = [[min(2**63 - 1, int(np.floor(x * 256))) for x in v] for _, v in rows]
    want = sorted(((-min(2**63 - 1, sum(a * b for a, b in zip(whole[0], w))), i) for i, w in enumerate(whole) if i))
    assert [(r.vec_id, r.score) for r in found.orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_usable(spark):
    rows = [(r[1],) for r in ODD]
    got = spark.createDataFrame(rows, "v array<float>").select(usable(F.col("v"))).collect()
    assert [r[0] for r in got] == [False, True, True, False, False, False, True, True, True, True]


def test_queries_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op1_vector_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == brute_links(rows)
    found = QUERIES["op6_top_k"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in found} == brute_top(rows)
