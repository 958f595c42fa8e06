"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Equal vectors are one vector with a weight. Normalised vectors are projected on random directions, shifted
and cut into cells of one width; the cells of a few projections together are a bucket, and there are several
tables of buckets. A cosine of at least c is a distance of at most sqrt(2 - 2 c): with cells of width 2, 14
projections a table and 40 tables, a pair with cosine 0.95 meets in some table with a probability of 0.998,
closer pairs more surely. Pairs that meet are checked by their cosine in double precision.

Buckets of any size are worked on whole: a bucket is dealt into blocks, and every two blocks meet in a group
of bounded size (groups hold many buckets where those are small). A pair counts in the first table that it shares only, so no list of pairs is ever made: groups
give numbers of links and a spanning forest, and the links of all forests give the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components have no links; vectors
of different lengths are not linked; repeated rows are vectors of their own; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import components, written
from vigilframe.llm.topk import usable

COSINE, WIDTH, PROJECTIONS, TABLES, BLOCK, SEED = 0.95, 2.0, 14, 40, 512, 20240229
GROUP = 1024


def unit_rows(vectors) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    x = np.array(list(vectors), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(unit: np.ndarray, width: float, projections: int, tables: int, seed: int) -> np.ndarray:
    """One 32-bit bucket number per row and table."""
    draw = np.random.default_rng([seed, unit.shape[1]])
    directions = draw.standard_normal((unit.shape[1], tables * projections))
    shifts = draw.uniform(0.0, width, tables * projections)
    odd = draw.integers(1, 2**63, tables * projections, dtype=np.uint64) | np.uint64(1)
    cell = np.floor((unit @ directions + shifts) / width).astype(np.int64).astype(np.uint64)
    mixed = (cell * odd).reshape(len(unit), tables, projections).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def links(left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with at least this cosine; figures next to the bound are summed again exactly."""
    product = left @ right.T
    i, j = np.nonzero(product >= cosine - 1e-9)
    close = np.flatnonzero(np.abs(product[i, j] - cosine) <= 1e-9)
    keep = np.ones(len(i), dtype=bool)
    for at in close:
        keep[at] = math.fsum(left[i[at]] * right[j[at]]) >= cosine
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (i, j) reach."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            break
    return root


def check_buckets(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links inside the buckets of a table: per vector the number of links found here, and a link to the root of
    its tree in the bucket's spanning forest."""
    frame = frame.sort_values(["bucket", "low", "high", "block", "uid"], kind="stable")
    unit, cell = unit_rows(frame["embedding"]), np.array(frame["cells"].tolist(), dtype=np.int32)
    uid, weight = frame["uid"].to_numpy(), frame["weight"].to_numpy(dtype=np.float64)
    table, block = int(frame["table"].iloc[0]), frame["block"].to_numpy()
    low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
    group = frame[["bucket", "low", "high"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    found = [np.zeros((3, 0), dtype=np.int64)]
    for start, end in zip(starts, np.r_[starts[1:], len(frame)]):
        # two blocks meet, or one block meets itself
        middle = start if low[start] == high[start] else start + int((block[start:end] == low[start]).sum())
        i, j = links(unit[start:end] if middle == start else unit[start:middle], unit[middle:end], cosine)
        j += middle - start
        if middle == start:
            i, j = i[i < j], j[i < j]
        if table and len(i):
            new = [
                ~(cell[start + i[at : at + 65536], :table] == cell[start + j[at : at + 65536], :table]).any(axis=1)
                for at in range(0, len(i), 65536)
            ]
            new = np.concatenate(new)
            i, j = i[new], j[new]
        if len(i):
            size, w = end - start, weight[start:end]
            n = np.bincount(i, w[j], size) + np.bincount(j, w[i], size)
            linked = np.flatnonzero(n)
            root = forest(size, i, j)[linked]
            found.append(np.stack([uid[start + linked], uid[start + root], n[linked].astype(np.int64)]))
    return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["uid", "other", "n"])


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    width: float = WIDTH,
    projections: int = PROJECTIONS,
    tables: int = TABLES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id, kept, and class_id (smallest vec_id with an equal vector, else null)."""
    embedding = F.col("embedding")
    linkable = usable(embedding) & F.exists(embedding, lambda x: x != 0)
    good = vectors.where(linkable).select("vec_id", "embedding")
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight"))
    classes = classes.withColumn("uid", F.monotonically_increasing_id())

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dims = frame["embedding"].map(len)
            found: list = [None] * len(frame)
            for d in dims.unique():
                at = np.flatnonzero(dims == d)
                rows = cells(unit_rows(frame["embedding"].iloc[at]), width, projections, tables, seed)
                for place, row in zip(at, rows):
                    found[place] = row
            yield frame.assign(cells=found, dim=dims.astype("int32"))

    id_kind, kind = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))
    schema = f"uid long, class_id {id_kind}, weight long, embedding {kind}, cells array<int>, dim int"
    narrow = classes.select("uid", "class_id", "weight", "embedding")
    classes = written(written(narrow, "vector-classes").mapInPandas(signed, schema), "vector-cells")

    met = classes.select("uid", "dim", F.posexplode("cells").alias("table", "bucket"))
    sizes = met.groupBy("dim", "table", "bucket").agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = written(sizes, "vector-buckets")
    met = met.join(sizes, ["dim", "table", "bucket"])
    blocks = F.expr(f"int((_n + {block - 1}) div {block})")
    met = met.withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int"))
    met = met.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select(
        "uid", "dim", "table", "bucket", "block", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high")
    )
    met = met.join(classes.select("uid", "weight", "embedding", "cells"), "uid")

    # many small buckets share a group, so that a group has about GROUP rows, whatever the number of rows
    rows = sizes.agg(F.sum(F.col("_n") * blocks)).first()[0] or 0
    part = F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(max(1, rows // (GROUP * tables))))

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        return check_buckets(frame, cosine)

    found = (
        met.withColumn("part", part)
        .groupBy("dim", "table", "part")
        .applyInPandas(check, "uid long, other long, n long")
    )
    found = written(found, "vector-links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("_links"))
    group = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")))
    group = group.withColumnRenamed("id", "uid").withColumnRenamed("component_id", "_root")
    own = classes.select("uid", "class_id", "weight").join(counts, "uid", "left").join(group, "uid", "left")
    own = own.withColumn("_root", F.coalesce("_root", "uid"))
    roots = own.groupBy("_root").agg(F.min("class_id").alias("component_id"))
    own = own.join(roots, "_root").select(
        "uid", "class_id", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    own = own.join(classes.select("uid", "embedding"), "uid").drop("uid")
    listed = good.join(own, "embedding").select("vec_id", "n_links", "component_id", "class_id")
    rest = vectors.where(~F.coalesce(linkable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast(id_kind).alias("class_id")
    )
    return listed.unionByName(rest).select(
        "vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"), "class_id"
    )
