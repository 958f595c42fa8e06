"""Merkle manifest of a table: bitmaps give every row its leaf, slot arrays give the levels above.

Rows are hashed once. Their ids set bits in bitmaps, one per group, held as 64-bit words that have any bit set;
partial bitmaps are merged with OR, and a directory keeps how many rows stand before each word. The place of a
row among the leaves of its group is then what its word's directory says plus the bits below its own: no
leaf is sorted. 4096 neighbouring leaves meet in one array, each in the slot of its place, and four levels are
hashed there; their tops are leaves of the next round, so 10^10 rows take three rounds. On the way down each array
gets the path of its top and hands on, or folds, the paths of its members.

Groups are ordered by name and their subroots are the leaves of the last tree, built the same way.

Defined cases: a null in any column is hashed as such; rows without id come first in their group; rows of one id
are ordered by their leaves, and equal rows get a leaf each; a row without id is never tampered with; a null group
is a group of its own, before all others; empty texts have length 0; texts of any length are hashed whole; an
empty table gives an empty table; columns that are not named are not looked at. Ids are integers.

A group of equal ids (or of rows without id) of any size is spread over the first bits of its leaves, equal rows
are counted before they move, so no task holds more than a small part of either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vigilframe.llm.common import group_key, running, written

FANOUT_BITS, DEPTH = 3, 4
FANOUT, SPAN_BITS = 1 << FANOUT_BITS, FANOUT_BITS * DEPTH
SPAN = 1 << SPAN_BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The word of rows without id: below all words of ids.
NO_ID = -(1 << 60)
#: Bits of a leaf that spread the rows of one id.
SPREAD_BITS = 16
#: Rows that a worker holds ready before it hands them on.
HELD = 2048

PATH_NAMES = ("slots", "runs", "subroot", "root")
PATH = "slots array<int>, runs array<binary>, subroot binary, root binary"


def digest(nodes: Sequence[bytes]) -> bytes:
    """Hash of a run of nodes: of their hex texts, one after the other."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def leaf(columns: Iterable[Column]) -> Column:
    """Hash of the values of a row: ``-`` for a null, else length in bytes, colon, value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        held = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        return F.when(value.isNull(), F.lit("-")).otherwise(held)

    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def leaves(
    docs: DataFrame, columns: Sequence[str], group: str, key: str, presented: dict[str, Column], when: Column
) -> DataFrame:
    """group_key, key, node (leaf), other (leaf with the ``presented`` values, where asked) and copies; written."""
    own = [F.col(c) for c in columns]
    other = F.when(when, leaf([presented.get(c, F.col(c)) for c in columns]))
    rows = docs.select(
        group_key(group).alias("group_key"), F.col(key).cast("long").alias("key"), leaf(own).alias("node"), other.alias("other")
    )
    return written(rows.groupBy("group_key", "key", "node", "other").agg(F.count("*").alias("copies")), "leaves")


def numbered(rows: DataFrame, order: Sequence[str], keys: Sequence[str], amount: Column) -> DataFrame:
    """``before`` and ``total`` of ``amount`` for rows in the order of ``keys`` and ``order``, by ranges of rows."""
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    return running(written(ranged, "ranged"), list(keys), "_range", [F.col(c) for c in order], amount).drop("_range")


def places(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of a row in its group, and ``total``, the rows of the group."""
    word = F.coalesce(F.shiftright("key", 6), F.lit(NO_ID))
    bit = F.coalesce(F.col("key").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    rows = rows.withColumns({"word": word, "bit": bit})
    bitmaps = rows.groupBy("group_key", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("copies").alias("n")
    )
    directory = numbered(bitmaps, ["word"], ["group_key"], F.col("n"))
    directory = written(directory, "directory")
    met = rows.join(directory, ["group_key", "word"])
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)"))
    names = ("group_key", "key", "node", "other", "copies", "total")
    single = F.col("n") == F.bit_count("bits")
    placed = met.where(single).select(*names, (F.col("before") + below).alias("pos"))
    shared = directory.where(~single).select("group_key", "word", "total", F.col("before").alias("ahead"))
    if shared.isEmpty():
        return placed
    # ids that several rows have: the rows of their words are ordered by id and leaf
    spread = F.conv(F.substring(F.hex("node"), 1, SPREAD_BITS // 4), 16, 10).cast("int")
    tied = rows.join(shared, ["group_key", "word"]).withColumn("_bucket", F.shiftleft("bit", SPREAD_BITS) + spread)
    order = [F.col("key"), F.col("node")]
    within = running(tied.withColumnRenamed("total", "_all"), ["group_key", "word"], "_bucket", order, F.col("copies"))
    return placed.unionByName(
        within.drop("total").withColumnRenamed("_all", "total").select(*names, (F.col("ahead") + F.col("before")).alias("pos"))
    )


def arrays(items: DataFrame, paths: DataFrame | None, work: Callable, schema: str) -> DataFrame:
    """Runs ``work(group_key, chunk, path, members)`` on every 4096 neighbouring places of a group.

    ``items`` hold group_key, pos, total, node, copies and others; equal rows are split where an array ends.
    Members come as dicts. Arrays are met one after the other in a sorted partition, each with the path
    of its top, if there are ``paths``, before it: a worker holds one array.
    """
    last = F.col("pos") + F.col("copies") - 1
    chunks = F.sequence(F.shiftright("pos", SPAN_BITS), F.shiftright(last, SPAN_BITS))
    own = [c for c in items.columns if c not in ("pos", "copies", "group_key")]
    rows = items.select("*", F.explode(chunks).alias("chunk"), last.alias("_last"))
    start = F.greatest("pos", F.expr(f"shiftleft(chunk, {SPAN_BITS})"))
    end = F.least("_last", F.expr(f"shiftleft(chunk + 1, {SPAN_BITS}) - 1"))
    rows = rows.select("group_key", "chunk", F.lit(1).alias("kind"), start.alias("pos"), (end - start + 1).alias("copies"), *own)
    if paths is not None:
        tops = paths.select("group_key", F.col("pos").alias("chunk"), F.lit(0).alias("kind"), *PATH_NAMES)
        rows = tops.unionByName(rows, allowMissingColumns=True)

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for members in in_turn(tables):
            path = members.pop(0) if members[0]["kind"] == 0 else None
            for found in work(members[0]["group_key"], members[0]["chunk"], path, members):
                out.append(found)
                if len(out) == HELD:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    dealt = rows.repartition("group_key", "chunk").sortWithinPartitions("group_key", "chunk", "kind")
    return dealt.mapInArrow(batches, schema)


def in_turn(tables: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of a sorted partition, array by array."""
    held: list[dict] = []
    for batch in tables:
        for row in batch.to_pylist():
            if held and (held[0]["chunk"] != row["chunk"] or held[0]["group_key"] != row["group_key"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def levels(members: list[dict]) -> list[list[bytes]]:
    """Nodes of one array from its members, each in the slot of its place, up to its top."""
    size = sum(m["copies"] for m in members)
    slots: list = [None] * size
    for m in members:
        at = m["pos"] & (SPAN - 1)
        slots[at : at + m["copies"]] = [m["node"]] * m["copies"]
    if len(slots) != size or None in slots:
        raise ValueError("the places of an array are not those of its members")
    found = [slots]
    whole = members[0]["total"] <= SPAN
    while len(found[-1]) > 1 if whole else len(found) <= DEPTH:
        below = found[-1]
        found.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return found


def tops(group: str, chunk: int, path: dict | None, members: list[dict]) -> Iterator[dict]:
    total = -(-members[0]["total"] // SPAN)
    yield {"group_key": group, "pos": chunk, "total": total, "node": levels(members)[-1][0], "copies": 1}


def way(found: list[list[bytes]], at: int) -> tuple[list[int], list[bytes]]:
    """Slots and runs (the nodes of a run one after the other) from a member to the top of its array."""
    slots, runs = [], []
    for nodes in found[:-1]:
        start = at >> FANOUT_BITS << FANOUT_BITS
        slots.append(at - start)
        runs.append(b"".join(nodes[start : start + FANOUT]))
        at >>= FANOUT_BITS
    return slots, runs


def ways(group: str, chunk: int, path: dict, members: list[dict]) -> Iterator[dict]:
    """The path of each member to the root; a member with a name is the subroot of that group."""
    found = levels(members)
    for m in members:
        slots, runs = way(found, m["pos"] & (SPAN - 1))
        yield {
            **m,
            "slots": slots + path["slots"],
            "runs": runs + path["runs"],
            "subroot": m["node"] if "name" in m else path["subroot"],
            "root": path["root"],
        }


def siblings(slots: list[int], runs: list[bytes]) -> list[bytes]:
    return [run[: 32 * s] + run[32 * s + 32 :] for s, run in zip(slots, runs)]


def fold(node: bytes, slots: list[int], others: list[bytes]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for s, rest in zip(slots, others):
        node = digest([rest[: 32 * s], node, rest[32 * s :]])
    return node


def proofs(group: str, chunk: int, path: dict, members: list[dict]) -> Iterator[dict]:
    """Every copy of every leaf with its proof and with the root that it (or the other leaf) folds to."""
    found = levels(members)
    above = siblings(path["slots"], path["runs"])
    for m in members:
        for at in range(m["pos"], m["pos"] + m["copies"]):
            slots, runs = way(found, at & (SPAN - 1))
            rest = siblings(slots, runs) + above
            slots += path["slots"]
            folded = fold(m["node"] if m["other"] is None else m["other"], slots, rest)
            yield {
                "group_key": group,
                "key": m["key"],
                "position": at,
                "leaf": m["node"].hex(),
                "subroot": path["subroot"].hex(),
                "root": path["root"].hex(),
                "slots": slots,
                "proof": [r.hex() for r in rest],
                "folded_root": folded.hex(),
            }


PROOF = (
    "group_key string, key long, position long, leaf string, subroot string, root string, "
    "slots array<int>, proof array<string>, folded_root string"
)
NODE = "group_key string, pos long, total long, node binary, copies long"


def grown(items: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The items of every round, and the top of each group with the number of its rounds (``height``)."""
    rounds, ready = [items], []
    while True:
        nodes = written(arrays(rounds[-1], None, tops, NODE), "nodes")
        ready.append(nodes.where("total = 1").withColumn("height", F.lit(len(rounds))))
        left = nodes.agg(F.max("total")).first()[0]
        if left is None or left == 1:
            break
        rounds.append(nodes.where("total > 1"))
    done = ready[0]
    for more in ready[1:]:
        done = done.unionByName(more)
    return rounds, done


def descended(rounds: list[DataFrame], top_paths: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on the arrays of the first round, with the paths that come down from the groups' tops."""
    paths = None
    for height in range(len(rounds), 0, -1):
        start = top_paths.where(F.col("height") == height).select("group_key", F.lit(0).cast("long").alias("pos"), *PATH_NAMES)
        paths = start if paths is None else start.unionByName(paths)
        items = rounds[height - 1]
        if height == 1:
            return arrays(items, paths, work, schema)
        paths = written(arrays(items, paths, ways, f"group_key string, pos long, {PATH}"), "paths")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    key: str = "doc_id",
    presented: dict[str, Column] | None = None,
    when: Column | None = None,
) -> DataFrame:
    """A row per row of ``docs``: group_key (``n``, or ``v`` and the group), key, position in the group, leaf,
    subroot of the group, root, proof (siblings per level as hex, from leaf to root), slots (the own place among
    them), and folded_root, recomputed from the proof.

    With ``presented`` the root of rows for which ``when`` holds is folded from a leaf with these values instead
    of the columns' own: it is the root only if the values are those of the manifest.
    """
    hashed = leaves(docs, columns, group, key, presented or {}, F.lit(False) if when is None else when)
    placed = written(places(hashed), "placed")
    rounds, done = grown(placed)
    return _with_groups(rounds, done)


def _with_groups(rounds: list[DataFrame], done: DataFrame) -> DataFrame:
    """The tree of the groups, one nameless group whose leaves are the subroots by name; then all proofs."""
    subroots = done.select(F.lit("").alias("group_key"), F.col("group_key").alias("name"), "node", "height")
    ordered = numbered(subroots, ["name"], ["group_key"], F.lit(1).cast("long"))
    items = written(
        ordered.select("group_key", F.col("before").alias("pos"), "total", "node", F.lit(1).cast("long").alias("copies"), "name", "height"),
        "subroots",
    )
    over, root = grown(items.drop("height"))
    empty = F.array().cast("array<int>").alias("slots"), F.array().cast("array<binary>").alias("runs")
    from_root = root.select("group_key", "height", *empty, F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"))
    found = descended(over, from_root, ways, f"name string, {PATH}")
    heights = items.select("name", "height")
    top_paths = written(found.join(heights, "name").withColumnRenamed("name", "group_key"), "group-paths")
    return descended(rounds, top_paths, proofs, PROOF)


def verified(docs: DataFrame) -> DataFrame:
    """Digests of the manifest's proofs, with the A-Z of texts lowered in rows of every third id (by crc32)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = {"text": F.translate("text", letters, letters.lower())}
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, presented=lowered, when=third)
    return rows.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
