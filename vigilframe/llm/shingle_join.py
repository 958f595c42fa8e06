"""Near-duplicate texts: a Jaccard join on word n-grams with several global token orders.

A text is the set of its distinct shingles. Texts with the same set are one class, and classes are joined. If two sets
overlap enough, their prefixes under any order of all tokens share a token; so a pair is a candidate only if
it shares prefix tokens under every one of ORDERS orders. All orders put tokens that are frequent last (as far as
prefixes tell; any marking would be right) and differ in the hash that orders the rest. The first order is an
inverted index; its pairs must fit in length and in a parity sketch that never overstates how much two sets
differ; the prefixes under the other orders are intersected before the sets themselves are compared.

Only pairs between different components are of interest, as the result is classes and components. A list takes all
its pairs if they are no more than FEW times its members; else every member names its nearest partners of
other components, one and WIDER more for each of its pairs that failed, and the list has another round when the
verified pairs have merged components; pairs that failed are not taken again. So a member that meets no similar set
has named all of a block after three rounds. The rounds end when no list has held pairs back, so no link between
components is lost, while a large group of near copies costs rows in its size, not its square. Lists of any length are
dealt into blocks that meet in pairs. Where a round has many pairs for its sets, sketches in the size of the sets part
most of those that fall short, before any text is sent for a pair.

Defined cases: A-Z are lower-cased and words end at space and the controls 9 to 13; a text with fewer words than a
shingle is one shingle; null texts and texts without words have the empty set, no links and a component of
their own; repeated rows are members of a class; rows that share an id share a component; an empty table gives an empty
table; a row without id has no component but that of its copies. Texts are compared whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import components, map_texts, written

ORDERS, SKETCH_BITS, FREQUENT, BLOCK, GROUP, FEW, WIDER = 3, 1024, 4, 512, 1024, 4, 15
#: Longest sketch of a set, in bits.
WIDEST = 1 << 17
#: Bits of frequent tokens go to the driver in blocks of so many (a power of two), 32,768 blocks of 4 KB at most.
MARKS_A_BLOCK = 15
#: Bits that mark frequent tokens: 16 a token, between these powers of two.
LEAST_MARKS, MOST_MARKS = 16, 30
#: Rows that a worker holds ready before it hands them on.
HELD = 512
#: Ids of texts that are wanted are broadcast up to this number; beyond it the texts are shuffled.
BROADCAST_ROWS = 1_000_000
REMEMBERED = 150_000

_ODD = [np.uint64(x) for x in np.random.default_rng(7).integers(2**62, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


class Shingles(dict):
    """Sorted distinct 64-bit hashes of the word n-grams of texts; remembers hashes of words."""

    def __init__(self, words: int, salt: int):
        super().__init__()
        self.words, self.salt = words, salt

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word, self.salt)
        return found

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        hashes = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(hashes))
        if not size:
            return hashes
        grams = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            grams += hashes[k : len(hashes) - size + 1 + k] * _ODD[k % 32]
        return np.unique(_mix(grams, _ODD[40]))

    def key(self, grams: np.ndarray) -> tuple[int, int]:
        data = grams.tobytes()
        return tuple(
            x - 2**64 if x >= 2**63 else x for x in (xxhash.xxh3_64_intdigest(data, self.salt + s) for s in (1, 2))
        )


def prefix_length(n: int, percent: int) -> int:
    """So many tokens of a set of n hold one of any set that is similar enough, in whatever order."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def prefix(grams: np.ndarray, frequent: np.ndarray, length: int, order: int) -> np.ndarray:
    """First tokens in this order; ``frequent`` marks the tokens that come last."""
    key = grams if not order else _mix(grams, _ODD[40 + order])
    rare, common = key[~frequent], key[frequent]
    if len(rare) >= length:
        return np.sort(rare)[:length] if order else rare[:length]
    return np.r_[rare, np.sort(common)[: length - len(rare)]]


def sketch(grams: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parities of the tokens that fall on each of so many places."""
    places = (grams >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(grams: np.ndarray) -> bytes:
    """A sketch of four places a token, a power of two and WIDEST at most."""
    return sketch(grams, min(WIDEST, max(SKETCH_BITS, 1 << (4 * len(grams)).bit_length())))


def parted(left: bytes, right: bytes) -> int:
    """No more than the number of tokens in which two sets differ; the longer sketch is folded to the shorter."""
    a, b = (np.frombuffer(x, dtype=np.uint64) for x in (left, right))
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def marked(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which tokens fall on a set bit of the table (a power of two of 64-bit words)."""
    slot = grams & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def sets_of(docs: DataFrame, words: int, percent: int, salt: int) -> DataFrame:
    """doc_id, sid and check (two hashes of the set), n, and slots of the first prefix by hash alone; written."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words, salt)
        low = np.uint64((1 << MOST_MARKS) - 1)
        for frame in frames:
            for at in range(0, len(frame), HELD):
                part, rows = frame.iloc[at : at + HELD], []
                for text in part["text"]:
                    grams = shingles.of(text)
                    first = grams[: prefix_length(len(grams), percent)]
                    rows.append((*shingles.key(grams), len(grams), (first & low).astype(np.int32)))
                found = pd.DataFrame(rows, columns=["sid", "check", "n", "slots"], index=part.index)
                yield pd.concat([part[["doc_id"]], found], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(map_texts(rows, batches, f"doc_id {kind}, sid long, check long, n long, slots array<int>"), "sets")


def frequent_marks(sets: DataFrame) -> np.ndarray:
    """Bits of the slots that prefixes meet FREQUENT times; 2**MOST_MARKS bits at most."""
    slots = sets.select(F.explode("slots").alias("slot"))
    counted = written(slots.groupBy("slot").count().where(F.col("count") >= FREQUENT).select("slot"), "frequent")
    bits = min(MOST_MARKS, max(LEAST_MARKS, (16 * counted.count()).bit_length()))
    slot = F.pmod(F.col("slot"), F.lit(1 << bits)) if bits < MOST_MARKS else F.col("slot")
    blocks = (
        counted.select(slot.cast("long").alias("slot"))
        .groupBy(F.shiftright("slot", MARKS_A_BLOCK).alias("block"))
        .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << MARKS_A_BLOCK) - 1))).alias("bits"))
    )
    table, size = np.zeros((1 << bits) // 8, dtype=np.uint8), 1 << MARKS_A_BLOCK >> 3
    for row in blocks.toLocalIterator():
        table[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, dtype=np.uint8)
    return table.view(np.uint64)


def features_of(docs: DataFrame, marks, words: int, percent: int, salt: int) -> DataFrame:
    """sid, doc_id, n, sketch and prefix of one text of each class; written."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, table, seen = Shingles(words, salt), marks.value, set()
        for frame in frames:
            rows = []
            for key, text in zip(frame["doc_id"], frame["text"]):
                grams = shingles.of(text)
                sid, _ = shingles.key(grams)
                if len(grams) and (sid, key) not in seen:
                    seen.add((sid, key))
                    first = prefix(grams, marked(grams, table), prefix_length(len(grams), percent), 0)
                    rows.append((key, sid, len(grams), sketch(grams), first.view(np.int64)))
                if len(rows) >= HELD:
                    yield pd.DataFrame(rows, columns=["doc_id", "sid", "n", "sketch", "prefix"])
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "sid", "n", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = map_texts(rows, batches, f"doc_id {kind}, sid long, n long, sketch binary, prefix array<long>")
    # a class is stood for by its smallest id
    first = F.min_by(F.struct("doc_id", "n", "sketch", "prefix"), "doc_id")
    return written(found.groupBy("sid").agg(first.alias("_f")).select("sid", "_f.*").where("n > 0"), "shingle-features")


def index_lists(features: DataFrame) -> DataFrame:
    """token, sid, length: lists of classes that share a prefix token, each set of classes once; written."""
    # dealt by token once, for the counts and for the join
    rows = features.select("sid", F.explode("prefix").alias("token")).repartition("token")
    lists = rows.groupBy("token").agg(
        F.count("*").alias("length"),
        F.bit_xor(F.xxhash64("sid")).alias("_x"),
        F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("_y"),
    )
    lists = lists.where("length > 1").groupBy("length", "_x", "_y").agg(F.min("token").alias("token"))
    return written(rows.join(lists.select("token", "length"), "token"), "shingle-lists")


def near_pairs(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components that may be similar enough, in the lists (or meeting blocks) given here;
    a pair of a token with itself says that its list has held pairs back."""
    frame = frame.sort_values(["token", "low", "high", "block", "sid"], kind="stable")
    sid, n, component = (frame[c].to_numpy() for c in ("sid", "n", "component"))
    bits = np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)
    failed = [frozenset(x) if x is not None and len(x) else None for x in frame["failed"]]
    tried = np.array([len(x) if x else 0 for x in failed], dtype=np.int64)
    block, low, high = (frame[c].to_numpy() for c in ("block", "low", "high"))
    group = frame[["token", "low", "high"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    found = [np.zeros((2, 0), dtype=np.int64)]
    for start, end in zip(starts, np.r_[starts[1:], len(frame)]):
        middle = start if low[start] == high[start] else start + int((block[start:end] == low[start]).sum())
        a = np.arange(start, end if middle == start else middle)
        b = np.arange(middle, end)
        small, large = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
        fits = (component[a][:, None] != component[b][None, :]) & (100 * small >= percent * large)
        i, j = np.nonzero(fits)
        if middle == start:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        apart = np.concatenate(
            [
                np.bitwise_count(bits[a[i[at : at + 32768]]] ^ bits[b[j[at : at + 32768]]]).sum(axis=1, dtype=np.int64)
                for at in range(0, len(i), 32768)
            ]
        )
        i, j = a[i], b[j]
        # sets that are similar enough differ in (100 - percent) / (100 + percent) of all their tokens at most
        near = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        i, j, apart = i[near], j[near], apart[near]
        for at in range(len(i)):
            if failed[i[at]] is not None and int(sid[j[at]]) in failed[i[at]]:
                apart[at] = -1
        i, j, apart = i[apart >= 0], j[apart >= 0], apart[apart >= 0]
        if len(i) > FEW * (end - start):
            every = len(i)
            one, other = np.r_[i, j], np.r_[j, i]
            order = np.lexsort((sid[other], np.r_[apart, apart], one))
            one, other = one[order], other[order]
            first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
            place = np.arange(len(one)) - np.repeat(first, np.diff(np.r_[first, len(one)]))
            named = place < 1 + WIDER * tried[one]
            i, j = np.unique(np.sort(np.stack([one[named], other[named]]), axis=0), axis=1)
            if len(i) < every:
                found.append(np.full((2, 1), group[start, 0]))
        found.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])]))
    return pd.DataFrame(np.unique(np.concatenate(found, axis=1), axis=1).T, columns=["a", "b"])


def candidates(
    lists: DataFrame, features: DataFrame, member: DataFrame | None, failed: DataFrame | None, percent: int
) -> DataFrame:
    """Distinct pairs (a, b) of one round, see ``near_pairs``; written."""
    rows = lists
    if member is None:
        rows = rows.withColumn("component", F.col("sid"))
    else:
        rows = rows.join(member.withColumnRenamed("id", "sid"), "sid", "left")
        rows = rows.withColumn("component", F.coalesce("component_id", "sid")).drop("component_id")
        rows = written(rows, "shingle-members")
        mixed = rows.groupBy("token").agg(F.min("component").alias("_l"), F.max("component").alias("_h"))
        rows = rows.join(mixed.where("_l <> _h").select("token"), "token")
    blocks = F.expr(f"int((length + {BLOCK - 1}) div {BLOCK})")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("low", F.least("block", "_with")).withColumn("high", F.greatest("block", "_with")).drop("_with")
    count = rows.agg(F.count("*")).first()[0]
    rows = rows.join(features.select("sid", "n", "sketch"), "sid")
    none = F.lit(None).cast("array<bigint>")
    if failed is not None:
        both = failed.select(F.col("a").alias("sid"), F.col("b").alias("_o")).unionByName(
            failed.select(F.col("b").alias("sid"), F.col("a").alias("_o"))
        )
        rows = rows.join(both.groupBy("sid").agg(F.collect_list("_o").alias("failed")), "sid", "left")
    else:
        rows = rows.withColumn("failed", none)
    part = F.pmod(F.xxhash64("token", "low", "high"), F.lit(max(1, count // GROUP)))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return near_pairs(frame, percent)

    pairs = rows.withColumn("part", part).groupBy("part").applyInPandas(meet, "a long, b long")
    return written(pairs.distinct(), "shingle-pairs")


def sketched(pairs: DataFrame, texts: DataFrame, words: int, percent: int, salt: int) -> DataFrame:
    """(a, b, near): whether wide sketches of the two sets leave them similar enough; written."""

    def sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words, salt)
        for frame in frames:
            rows = []
            for sid, text in zip(frame["sid"], frame["text"]):
                grams = shingles.of(text)
                if shingles.key(grams)[0] == sid:  # not another text under an id that is not unique
                    rows.append((sid, len(grams), wide_sketch(grams)))
            yield pd.DataFrame(rows, columns=["sid", "n", "wide"])

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            differ = np.array([parted(x, y) for x, y in zip(frame["left"], frame["right"])], dtype=np.int64)
            near = differ * (100 + percent) <= frame["n"].to_numpy() * (100 - percent)
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "near": near})

    wide = written(map_texts(texts, sketches, "sid long, n long, wide binary").dropDuplicates(["sid"]), "shingle-sketches")
    both = pairs.join(wide.select(F.col("sid").alias("a"), F.col("n").alias("_n"), F.col("wide").alias("left")), "a")
    both = both.join(wide.select(F.col("sid").alias("b"), "n", F.col("wide").alias("right")), "b")
    both = both.select("a", "b", (F.col("_n") + F.col("n")).alias("n"), "left", "right")
    return written(map_texts(both, compared, "a long, b long, near boolean"), "shingle-near")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, marks, words: int, percent: int, salt: int) -> DataFrame:
    """(a, b, linked): the other orders' prefixes first, then the sets, both made from the whole texts; written.

    With more than FEW pairs a set, wide sketches part what they can before the texts are sent for each pair.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = written(wanted.join(classes.select("sid", "doc_id"), "sid"), "shingle-wanted")
    many = wanted.count()
    ids = F.broadcast(wanted) if many <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(ids, "doc_id").select("sid", "text")
    apart = None
    if pairs.count() > FEW * many:
        near = sketched(pairs, texts, words, percent, salt)
        apart, pairs = near.where("NOT near").select("a", "b", F.lit(False).alias("linked")), near.where("near").select("a", "b")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, table = Shingles(words, salt), marks.value

        @lru_cache(maxsize=256)
        def read(text: str):
            grams = shingles.of(text)
            frequent, length = marked(grams, table), prefix_length(len(grams), percent)
            return grams, [prefix(grams, frequent, length, o) for o in range(1, ORDERS)], shingles.key(grams)[0]

        for frame in frames:
            linked = []
            for a, b, left, right in zip(frame["a"], frame["b"], frame["left"], frame["right"]):
                (x, x_prefixes, x_key), (y, y_prefixes, y_key) = read(left), read(right)
                if x_key != a or y_key != b:  # another text under an id that is not unique
                    linked.append(None)
                    continue
                if not all(np.isin(p, q).any() for p, q in zip(x_prefixes, y_prefixes)):
                    linked.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "linked": pd.array(linked, dtype="boolean")})

    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("left")), "a")
    both = both.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("right")), "b")
    checked = map_texts(both.select("a", "b", "left", "right"), batches, "a long, b long, linked boolean")
    checked = checked.where("linked is not null").groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))
    return written(checked if apart is None else checked.unionByName(apart), "shingle-links")


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, component_id and class_id per row of ``docs``, and the verified
    links (a, b) between class ids that hold the components together."""
    docs = docs.select("doc_id", "text")
    for salt in range(0, 100, 10):
        sets = sets_of(docs, words, percent, salt)
        classes = sets.where("n > 0").groupBy("sid").agg(
            F.min("doc_id").alias("doc_id"), F.min("check").alias("_l"), F.max("check").alias("_h")
        )
        classes = written(classes, "shingle-classes")
        if classes.where("_l <> _h").isEmpty():  # no two sets have the same number
            break
    marks = docs.sparkSession.sparkContext.broadcast(frequent_marks(sets))
    features = features_of(docs, marks, words, percent, salt)
    lists = index_lists(features)
    member = failed = links = None
    more = True
    while more:
        pairs = candidates(lists, features, member, failed, percent)
        held = pairs.where("a = b").select(F.col("a").alias("token"))
        more = not held.isEmpty()
        pairs = pairs.where("a <> b")
        if pairs.isEmpty():
            break
        checked = verified(pairs, docs, classes, marks, words, percent, salt)
        good, bad = checked.where("linked").select("a", "b"), checked.where("not linked").select("a", "b")
        links = good if links is None else links.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
        if more:
            # the other lists have had all their pairs looked at
            lists = written(lists.join(held, "token", "left_semi"), "shingle-lists")
        member = components(links)
    grouped = classes.select("sid", F.col("doc_id").alias("class_id"))
    if member is None:
        grouped = grouped.withColumn("component_id", F.col("class_id"))
        named = docs.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    else:
        grouped = grouped.join(member.withColumnRenamed("id", "sid"), "sid", "left")
        grouped = grouped.withColumn("_root", F.coalesce("component_id", "sid")).drop("component_id")
        least = grouped.groupBy("_root").agg(F.min("class_id").alias("component_id"))
        grouped = grouped.join(least, "_root").drop("_root")
        name = lambda c: classes.select(F.col("sid").alias(c), F.col("doc_id").alias(f"_{c}"))
        named = links.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    found = sets.select("doc_id", "sid", F.col("n").alias("n_shingles")).join(grouped, "sid", "left")
    found = found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"),
    )
    return found, named


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one document of each group (the smallest id); rows without id stay."""
    found = similar_groups(docs, words, percent)[0]
    found = written(found.select("doc_id", "component_id"), "shingle-groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    # ids with two texts are in two groups, or are there twice: only the latter loses a row
    left = docs.join(gone, "doc_id", "left_anti")
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = docs.join(twice, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").unionByName(again).select(*docs.columns)
