"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's documents, in a seeded order, are a line of words that is cut into blocks of equal length; two
passes over the line are on offer, as a document may be taken twice at most. Words are the seats, targets
the votes: shard by shard the highest quotients target / (2 seats + 1) win, which gives whole quotas of words per
shard, however small a source is. A source's quota is filled with a whole pass first, then with blocks in a seeded
permutation, the last one up to the word that fills the quota.

Defined cases: null sources are one source that comes last; a null or empty text has no words and gives none;
an empty table gives an empty table; repeated rows are documents of their own; ties between quotients go to
the source that comes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import BLANKS, group_key, hash_bucket, map_texts, running, word_count, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK = 32
WHITE = BLANKS.removesuffix("+")
#: Sources whose quotas are broadcast at most.
BROADCAST_SOURCES = 200_000
#: Parts that one pass over the sources cuts the range of a level into, and sources that it looks at together.
PARTS, HELD = 64, 1024


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: ``source_size``, ``weight`` and ``target``; ``sized`` has source, _key and size.

    Targets fill up like vessels: level times weight, where no target is above ``most`` times its source's
    size and the sum is ``share`` of all words. Sources in the order of size over weight stop one by one; the
    first that doesn't stop has the level of all that follow (after it, the figures only fall).
    """
    per = sized.groupBy("source", "_key").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    full = F.col("source_size") * float(most)
    by_ratio = one.orderBy(full / F.col("weight"), "_key")
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # from the other end, as a frame up to the last row would be summed again for every row
    rest = one.orderBy((full / F.col("weight")).desc(), F.desc("_key")).rowsBetween(Window.unboundedPreceding, 0)
    level = (
        F.sum("source_size").over(one) * F.lit(share) - F.coalesce(F.sum(full).over(ahead), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    per = per.withColumn("_own", level).withColumn("_stops", full <= F.col("_own") * F.col("weight"))
    per = per.withColumn("_level", F.max(F.when(~F.col("_stops"), F.col("_own"))).over(one))
    return per.select(
        "_key",
        "source_size",
        "weight",
        F.when(F.col("_stops"), full).otherwise(F.col("_level") * F.col("weight")).alias("target"),
    )


def seats_above(votes: np.ndarray, level) -> np.ndarray:
    """Seats whose quotients votes / (2 k + 1) aren't below the level."""
    return np.floor((votes / level + 1) / 2).astype(np.int64)


def lowest_levels(count: Callable, seats: np.ndarray, total: float, parties: int, largest: float) -> np.ndarray:
    """Per house the lowest level that gives out no more than its seats; ``count`` has the seats above levels.

    Positive floats are in the order of their bits, so the range of bits is cut until two neighbours are left.
    """
    low = (total / (2.0 * seats + parties + 2) / 2).view(np.int64)
    high = np.full(len(seats), largest * 2).view(np.int64)
    parts = np.arange(1, PARTS)
    while (high - low).max() > 1:
        size, rest = (x[:, None] for x in np.divmod(high - low, PARTS))
        points = np.c_[low, low[:, None] + size * parts + rest * parts // PARTS, high]
        over = (count(points[:, 1:-1].view(np.float64)) > seats[:, None]).sum(axis=1)
        house = np.arange(len(seats))
        low, high = points[house, over], points[house, over + 1]
    return high.view(np.float64)


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); equal quotients go to the first.

    A party has the seats whose quotients are above a level. Seats that are left then belong to quotients that
    are equal at that level: one each to the highest. ``quotas`` does the same on a table.
    """
    votes = np.maximum(np.asarray(votes, dtype=np.float64), 0.0)
    won = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or not votes.sum():
        return won
    count = lambda levels: seats_above(votes[:, None, None], levels).sum(axis=0)
    won = seats_above(votes, lowest_levels(count, np.array([seats]), votes.sum(), len(votes), votes.max())[0])
    while (left := seats - int(won.sum())) > 0:
        order = np.argsort(-(votes / (2 * won + 1)), kind="stable")
        won[order[: min(left, len(order))]] += 1
    return won


def counted(targets: DataFrame, levels: np.ndarray) -> np.ndarray:
    """Seats above each level, over all sources; one row per partition of the sources is added up."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(levels.shape, dtype=np.int64)
        for frame in frames:
            votes = frame["target"].to_numpy()
            for at in range(0, len(votes), HELD):
                for house, own in enumerate(levels):
                    found[house] += seats_above(votes[at : at + HELD, None], own).sum(axis=0)
        yield pd.DataFrame({"place": np.arange(found.size), "n": found.ravel()})

    parts = map_texts(targets.select("target"), batches, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(levels.size, dtype=np.int64)
    for row in parts.collect():  # one per level
        out[row.place] = row.n
    return out.reshape(levels.shape)


def quotas(targets: DataFrame, shards: int, block: int, most: int, seed: int) -> DataFrame:
    """_key, source_size, target, ``_blocks`` of a pass, ``_upto`` (words up to and with each shard) and the
    seeded permutation k -> (``_a`` k + ``_c``) mod blocks of every source; written.

    The method never takes a seat back when more seats are given out, so the seats of the first j shards
    together are the seats of a house j / shards of the size, and every shard's quotas are whole numbers.
    Levels come from sums over the sources, so that no list of sources is held anywhere.
    """
    total, parties, largest = targets.agg(F.sum("target"), F.count("*"), F.max("target")).first()
    levels, ties = np.full(shards, np.inf), targets.select("_key").limit(0).withColumn("_more", F.array().cast("array<int>"))
    if total:
        houses = np.array([round(total) * j // shards for j in range(1, shards + 1)])
        levels = lowest_levels(lambda at: counted(targets, at), houses, total, parties, largest)
        left = houses - counted(targets, levels[:, None])[:, 0]
        above = lambda level: F.floor((F.col("target") / F.lit(float(level)) + 1) / 2)
        next_ones = [
            F.when(
                above(level * (1 - 1e-12)) > above(level),
                F.struct(F.lit(j).alias("house"), F.lit(int(n)).alias("left"), (F.col("target") / (2 * above(level) + 1)).alias("quotient")),
            )
            for j, (level, n) in enumerate(zip(levels, left))
            if n > 0
        ]
        if next_ones:
            at_level = targets.select("_key", F.explode(F.array_compact(F.array(*next_ones))).alias("_n")).select("_key", "_n.*")
            first = Window.partitionBy("house").orderBy(F.desc("quotient"), "_key")
            won = at_level.withColumn("_row", F.row_number().over(first)).where("_row <= left")
            ties = won.groupBy("_key").agg(F.collect_list("house").alias("_more"))  # no more than ``shards``

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, size, target, more in zip(frame["_key"], frame["source_size"].tolist(), frame["target"].tolist(), frame["_more"]):
                upto, blocks = seats_above(target, levels), math.ceil(size / block)
                if more is not None:
                    upto[np.asarray(more, dtype=np.int64)] += 1
                draw = np.random.default_rng([seed, *key.encode()])
                a = int(draw.integers(1, 2**20))
                while blocks and math.gcd(a, blocks) != 1:
                    a += 1
                c = int(draw.integers(0, max(1, blocks)))
                rows.append((key, size, target, blocks, np.minimum(upto, most * size), a, c))
            yield pd.DataFrame(rows, columns=names)

    names = ["_key", "source_size", "target", "_blocks", "_upto", "_a", "_c"]
    schema = "_key string, source_size long, target double, _blocks long, _upto array<long>, _a long, _c long"
    rows = targets.select("_key", "source_size", "target").join(ties, "_key", "left")
    return written(map_texts(rows, batches, schema), "mix-quotas")


def mix(
    docs: DataFrame,
    shards: int = 16,
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and ``spans``: the words taken, as (shard, pass, start, words)
    in words of the document. ``keep`` names further columns of ``docs`` to hand through."""
    sized = written(
        docs.select(
            "doc_id",
            "source",
            word_count("text").alias("size"),
            F.xxhash64("text").alias("_text"),
            F.struct(*keep).alias("_kept") if keep else F.lit(None).cast("string").alias("_kept"),
        )
        .withColumn("_key", group_key("source"))
        .withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "_text"))
        .withColumn("_bucket", hash_bucket(F.col("_h"))),
        "mix-sizes",
    )
    targets = written(source_targets(sized, weights, share, most), "mix-targets")
    plan = quotas(targets, shards, block, most, seed)
    plan = F.broadcast(plan) if targets.count() <= BROADCAST_SOURCES else plan
    order = [F.col(c) for c in ("_h", "doc_id", "_text", "size")]
    placed = running(sized, ["_key"], "_bucket", order, F.col("size"))
    placed = placed.drop("total").join(plan, "_key")

    first = F.expr(f"before div {block}")
    last = F.expr(f"(before + size - 1) div {block}")
    quota = F.element_at("_upto", -1)
    place = lambda k: F.pmod(F.col("_a") * k + F.col("_c"), F.col("_blocks"))
    placed = placed.withColumn("_end", F.when(F.col("_blocks") > 0, place(F.col("_blocks") - 1)))  # of the last block, which
    lacks = F.col("_blocks") * block - F.col("source_size")  # words

    def of_pass(number):
        def ahead(k):  # words of the passes and blocks before it
            seats = place(k)
            return F.lit(number) * F.col("source_size") + seats * block - F.when(seats > F.col("_end"), lacks).otherwise(0)

        def span(s):
            k = s["k"]
            start = F.greatest(k * block, F.col("before"))
            end = F.least(k * block + F.least(F.lit(block), quota - s["ahead"]), F.col("before") + F.col("size"))
            return F.struct(
                F.size(F.filter("_upto", lambda u: u <= s["ahead"])).alias("shard"),
                F.lit(number).alias("pass"),
                (start - F.col("before")).alias("start"),
                (end - start).alias("words"),
            )

        blocks = F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("k"), ahead(k).alias("ahead")))
        chosen = F.filter(blocks, lambda s: s["ahead"] < quota)
        return F.filter(F.transform(chosen, span), lambda s: s["words"] > 0)

    spans = F.flatten(F.array(*[of_pass(n) for n in range(most)]))
    none = F.array().cast("array<struct<shard:int,pass:int,start:bigint,words:bigint>>")
    placed = placed.withColumn("spans", F.when((F.col("size") > 0) & (F.col("_blocks") > 0), spans).otherwise(none))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "spans", *(["_kept.*"] if keep else [])
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: a row of ``docs`` per pass and unbroken stretch of words that is taken, its text that part
    of the document's text as it stands (all of it where all is taken), ``n_chars`` (if there is one) its length."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "source", "text")
    rows = mix(inner, keep=("row",), **options)
    rows = rows.select("row", "size", "spans", F.explode(F.array_distinct(F.transform("spans", lambda s: s["pass"]))).alias("pass"))
    own = F.filter("spans", lambda s: s["pass"] == F.col("pass"))
    own = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["words"]).alias("end"))))
    # every word with the white space after it
    parts = F.split("row.text", rf"(?<={WHITE})(?=[^{WHITE[1:]})")
    rows = rows.withColumns({"own": own, "words": F.filter(parts, lambda w: w.rlike(rf"[^{WHITE[1:]}"))})
    begins = F.transform("own", lambda s, i: F.when(F.coalesce(F.get("own", i - 1)["end"] != s["start"], F.lit(True)), s["start"]))
    ends = F.transform("own", lambda s, i: F.when(F.coalesce(F.get("own", i + 1)["start"] != s["end"], F.lit(True)), s["end"]))
    rows = rows.withColumn("stretches", F.arrays_zip(F.array_compact(begins).alias("begin"), F.array_compact(ends).alias("end")))

    def text(s):
        words = F.slice("words", (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))
        part = F.regexp_replace(F.array_join(words, ""), rf"{WHITE}+$", "")
        return F.when(s["end"] - s["begin"] == F.col("size"), F.col("row.text")).otherwise(part)

    others = [F.col(f"row.`{c}`").alias(f"_{i}") for i, c in enumerate(names) if c not in ("text", "n_chars")]
    rows = rows.select(*others, F.explode(F.transform("stretches", text)).alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col(f"_{i}")).alias(c) for i, c in enumerate(names)])
