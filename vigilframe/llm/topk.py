"""Exact top-k by integer inner product, with a table of distances to pivots.

Vectors become whole numbers; the distance of every vector to each pivot is stored beside it. For a query,
the largest difference of two such distances is a lower bound of the distance between query and candidate,
which makes an upper bound of their inner product: (|q|² + |x|² - bound²) / 2. Candidates are evaluated in the
order of their bounds, and the search stops when the next bound is below the k-th score so far, so no
result depends on the pivots.

Queries meet candidates in blocks: both sides are dealt out by hash into blocks of bounded size, each pair of
blocks is one task's group, and the k best of the blocks are merged.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part;
a zero vector does; vectors of another length are no candidates; repeated rows of one id and vector count
once; a query has no candidate of its own id; scores beyond 64 bits are cut to the nearest; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilframe.llm.common import written

#: Pivots are chosen from a sample of this many vectors (drawn at random for lengths that it lacks); they only change
#: how much is evaluated.
PIVOTS, PIVOT_SAMPLE = 24, 2000
ROWS_A_BLOCK, QUERIES_A_BLOCK, STEP = 8192, 1024, 64
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the vector that is farthest from the ones so far."""
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def drawn_pivots(dim: int, count: int, scale: float) -> np.ndarray:
    """Pivots for a length that the sample lacks: drawn by the length alone, so that all tasks have the same ones."""
    return np.random.default_rng(dim).normal(0.0, scale, (count, dim))


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, scale: int = 256) -> DataFrame:
    """vec_id, ints, dim, square, distances: written, with pivots of each vector length."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("ints").collect()
    by_dim: dict[int, list] = {}
    for (ints,) in sample:
        by_dim.setdefault(len(ints), []).append(ints)
    chosen = {d: choose_pivots(np.array(v, dtype=np.float64), pivots) for d, v in by_dim.items() if d}

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dims = frame["ints"].map(len)
            square, distances = np.zeros(len(frame)), [np.zeros(0)] * len(frame)
            for d in dims.unique():
                at = np.flatnonzero(dims == d)
                x = np.array(frame["ints"].iloc[at].tolist(), dtype=np.float64).reshape(len(at), d)
                square[at] = (x * x).sum(1)
                if d:
                    own = chosen[d] if d in chosen else drawn_pivots(d, pivots, scale / d**0.5)
                    apart = np.stack([np.linalg.norm(x - p, axis=1) for p in own], axis=1)
                    for i, row in zip(at, apart):
                        distances[i] = row
            yield frame.assign(dim=dims.astype("int32"), square=square, distances=distances)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, ints array<long>, dim int, square double, distances array<double>"
    return written(vectors.select("vec_id", "ints").mapInPandas(batches, schema), "pivot-table")


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of this block for every query of the other."""
    out = []
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy()
    matrix = np.array(rows["ints"].tolist(), dtype=np.int64)
    large = np.abs(matrix.astype(np.float64)).max(initial=0.0)
    floats = matrix.astype(np.float64)
    square, apart = rows["square"].to_numpy(), np.array(rows["distances"].tolist(), dtype=np.float64).reshape(len(rows), -1)
    for uid, query, ints, own_square, own_apart in zip(
        queries["uid"], queries["vec_id"], queries["ints"], queries["square"], queries["distances"]
    ):
        others = ids != query
        q = np.asarray(ints, dtype=np.float64)
        if np.abs(q).max(initial=0.0) * large * max(1, len(q)) < EXACT and apart.shape[1]:
            bound = np.abs(apart - np.asarray(own_apart)).max(axis=1)
            upper = (square + own_square - bound * bound) / 2 + 1e-6 * (square + own_square) + 0.5
            order = np.flatnonzero(others)
            order = order[np.argsort(-upper[order], kind="stable")]
            scores, places, step = np.zeros(0), np.zeros(0, dtype=np.int64), max(STEP, k)
            for start in range(0, len(order), step):
                part = order[start : start + step]
                if len(scores) >= k and upper[part[0]] < scores[-1]:
                    break
                scores, places = np.r_[scores, floats[part] @ q], np.r_[places, part]
                best = np.lexsort((places, -scores))[:k]  # places are in the order of ids
                scores, places = scores[best], places[best]
            found = [(int(s), p) for s, p in zip(scores, places)]
        else:  # numbers so large that only exact integers will do
            exact = [(sum(int(a) * int(b) for a, b in zip(ints, matrix[p])), p) for p in np.flatnonzero(others)]
            found = sorted(exact, key=lambda x: (-x[0], x[1]))[:k]
        out += [(uid, query, ids[p], max(-(2**63), min(2**63 - 1, s))) for s, p in found]
    return pd.DataFrame(out, columns=["uid", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on ``vec_id``."""
    rows = vectors.where(usable(F.col(vector)) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", whole(F.col(vector), scale).alias("ints")).distinct()
    rows = pivot_table(rows, scale=scale).withColumn("uid", F.xxhash64("vec_id", "ints"))
    counted = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    row_blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(counted, (ROWS_A_BLOCK, QUERIES_A_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.col("uid"), F.lit(n)).cast("int")
    queries = rows.where(is_query).withColumn("query_block", block(query_blocks))
    queries = queries.withColumn("row_block", every(row_blocks))
    rows = rows.withColumn("row_block", block(row_blocks)).withColumn("query_block", every(query_blocks))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    by = ("dim", "query_block", "row_block")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right, k)

    found = (
        queries.groupBy(*by)
        .cogroup(rows.groupBy(*by))
        .applyInPandas(meet, f"uid long, query_id {kind}, vec_id {kind}, score long")
    )
    best = Window.partitionBy("uid", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
