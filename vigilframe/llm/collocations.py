"""Phrase collocations by best-first growth under admissible bounds.

A phrase of 2 to 4 words scores floor(2,000,000 a / (l + r)) at its worst cut, where a, l and r are the
occurrences of the phrase and of both parts. Whatever a phrase grows into on the right has no more occurrences than
itself and keeps its first word, so f / (f(first word) + f) bounds the scores of all that; the same holds to the left
with the last word. Two-word phrases are counted in full; then, per language, a frontier of the best bounds is
grown word by word, on both sides, as far down as the score of the phrase that stands at twice the wanted rank.
Everything that scores that much is then known, and whatever could remove it, too, as an extension of a phrase has
at least the phrase's own bound. While a language has fewer survivors than wanted, its frontier goes on to the
phrase at double the rank, and only newly opened phrases grow.

Words stand as 64-bit hashes of language and word. The words are counted as strings first; if any other word has the
hash of a frequent one, another seed is taken, so equal hashes are equal words wherever it matters. Frequent words,
frequent pairs and frontiers reach the tasks as tables of bits of fixed size: a bit too many costs work, never a
result. After the pairs, only runs of frequent pairs are read, not texts.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; texts
and words of any length are taken whole; phrases of equal score and occurrences are ordered by their bytes; fewer
phrases than wanted are all returned; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import BATCH_BYTES, written

TOP, LEAST, LONGEST = 2000, 30, 4
SCALE = 2_000_000
#: Words of texts that a worker counts at a time, distinct words that it remembers, rows in a batch that it returns.
CHUNK, REMEMBERED, ROWS = 1 << 20, 300_000, 1 << 16
#: Bits of a table of marks: 2**28 (32 MB) at most.
LEAST_MARKS, MOST_MARKS, BLOCK = 16, 28, 15
#: Candidates above this many are joined by shuffles.
BROADCAST_ROWS = 1_000_000
#: Parts of a language that are ranked before the language itself.
SALTS = 64

UPPER = bytes(range(65, 91))
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to lower case, ends of pieces to a full stop, tab to blank.
SIGNS = bytes.maketrans(UPPER + BREAKS + b"\t", UPPER.lower() + b"." * len(BREAKS) + b" ")
H = ("h1", "h2", "h3", "h4")


def map_batches(rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows.mapInArrow(function, schema)


def batches_of(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for at in range(0, size, ROWS):
        yield pa.RecordBatch.from_pydict({c: v[at : at + ROWS] for c, v in columns.items()})


def mix(*hashes: np.ndarray) -> np.ndarray:
    """One hash of the hashes of several words."""
    out = np.zeros(len(hashes[0]), dtype=np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def marked(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - (len(table) * 8).bit_length() + 1)
    return table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def marks(rows: DataFrame, columns: tuple[str, ...]):
    """Broadcast table of bits: one is set for every row's hashes; about one bit in 16, unless rows are very many."""
    bits = min(MOST_MARKS, max(LEAST_MARKS, (16 * rows.count()).bit_length()))

    def slots(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            found = mix(*[t.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in columns])
            yield pa.RecordBatch.from_pydict({"slot": (found >> np.uint64(64 - bits)).astype(np.int64)})

    places = rows.select(*columns).mapInArrow(slots, "slot long")
    block = F.shiftright("slot", BLOCK)
    blocks = places.groupBy(block.alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << BLOCK) - 1))).alias("bits")
    )
    table = np.zeros(1 << bits >> 3, dtype=np.uint8)
    size = 1 << BLOCK >> 3
    for row in blocks.collect():  # 8192 blocks of 4 KB at most
        table[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], dtype=np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table)


class Words:
    """The words that a task has met, numbered; 0 is the end of a piece."""

    def __init__(self, seed: int):
        self.seed = seed
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.hashed = np.zeros(1, dtype=np.uint64)

    def numbers(self, lang: str, text: bytes) -> np.ndarray:
        words = text.translate(SIGNS).replace(b".", b" . ").split()
        known = self.of.get(lang)
        if known is None:
            known = self.of[lang] = Numbers(lang, self.words)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def hashes(self) -> np.ndarray:
        import xxhash

        seen = len(self.hashed)
        if len(self.words) > seen:
            new = [xxhash.xxh64_intdigest(lang.encode() + b"\0" + w, self.seed) or 1 for lang, w in self.words[seen:]]
            self.hashed = np.concatenate([self.hashed, np.array(new, dtype=np.uint64)])
        return self.hashed


class Numbers(dict):
    """Number of each word of a language; a new word gets the next one."""

    def __init__(self, lang: str, words: list):
        super().__init__({b".": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append((self.lang, word))
        return number


def streams(tables: Iterator[pa.RecordBatch], words: Words) -> Iterator[np.ndarray]:
    """Texts as numbers of words, many at a time; every text ends with a 0."""
    end = np.zeros(1, dtype=np.int64)
    held, size = [], 0
    for table in tables:
        for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist()):
            part = words.numbers(lang, text)
            held += [part, end]
            size += len(part) + 1
            if size >= CHUNK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), value.alias("text"))


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """lang, word, h1 (its hash) and f of every word; written."""

    def counts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        total = np.zeros(0, dtype=np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            hashes = words.hashes().view(np.int64)
            for at in range(1, len(words.words), ROWS):
                part = words.words[at : at + ROWS]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang for lang, _ in part], pa.string()),
                        "word": pa.array([w.decode() for _, w in part], pa.string()),
                        "h1": hashes[at : at + ROWS],
                        "f": total[at : at + ROWS],
                    }
                )

        for numbers in streams(tables, words):
            found = np.bincount(numbers, minlength=len(words.words))
            found[: len(total)] += total
            total = found
            if len(words.words) > REMEMBERED:
                yield from out()
                words.clear()
                total = np.zeros(0, dtype=np.int64)
        yield from out()

    found = map_batches(rows, counts, "lang string, word string, h1 long, f long")
    return written(found.groupBy("lang", "word", "h1").agg(F.sum("f").alias("f")), "words")


def pair_counts(rows: DataFrame, seed: int, frequent, least: int) -> DataFrame:
    """h1, h2, a of all pairs of frequent words with at least ``least`` occurrences; written."""

    def counts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        for numbers in streams(tables, words):
            hashes = words.hashes()
            good = marked(mix(hashes), frequent.value)
            good[0] = False
            good = good[numbers]
            pairs = (numbers[:-1] << 32 | numbers[1:])[good[:-1] & good[1:]]
            found, n = np.unique(pairs, return_counts=True)
            own = hashes.view(np.int64)
            yield from batches_of({"h1": own[found >> 32], "h2": own[found & 0xFFFFFFFF], "a": n})
            if len(words.words) > REMEMBERED:
                words.clear()

    found = map_batches(rows, counts, "h1 long, h2 long, a long")
    counted = found.groupBy("h1", "h2").agg(F.sum("a").alias("a"))
    return written(counted.where(F.col("a") >= least), "pairs")


def pair_runs(rows: DataFrame, seed: int, pairs) -> DataFrame:
    """run: hashes of words in which every neighbouring pair is frequent, 0 between runs; written.

    Runs of two words are left out: no longer phrase is in them.
    """

    def runs(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(seed)
        for numbers in streams(tables, words):
            h = words.hashes()[numbers]
            good = marked(mix(h[:-1], h[1:]), pairs.value) & (h[:-1] != 0) & (h[1:] != 0)
            # a word stays where it is in a phrase of three
            three = np.zeros(len(h), dtype=bool)
            both = good[:-1] & good[1:]
            for shift in range(3):
                three[shift : len(h) - 2 + shift] |= both
            joined = np.r_[False, good] & three & np.r_[False, three[:-1]]  # to the word before
            kept = np.flatnonzero(three)
            starts = np.flatnonzero(~joined[kept])
            found = np.insert(h[kept], starts, 0)
            # in portions that end between runs
            ends = np.flatnonzero(found == 0)
            cuts = [0, *ends[np.searchsorted(ends, np.arange(CHUNK // 4, len(found), CHUNK // 4), "right") - 1].tolist(), len(found)]
            parts = [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:]) if b > a]
            if parts:
                yield pa.RecordBatch.from_pydict({"run": pa.array(parts, pa.binary())})
            if len(words.words) > REMEMBERED:
                words.clear()

    return written(map_batches(rows, runs, "run binary"), "runs")


def grown_counts(runs: DataFrame, size: int, right, left, least: int) -> DataFrame:
    """Phrases of ``size`` words that begin with a phrase marked in ``right`` or end with one marked in ``left``."""
    names = H[:size]

    def phrases(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for raw in table.column("run").to_pylist():
                h = np.frombuffer(raw, dtype=np.uint64)
                places = len(h) - size + 1
                if places < 1:
                    continue
                words = [h[i : i + places] for i in range(size)]
                grows = marked(mix(*words[:-1]), right.value) | marked(mix(*words[1:]), left.value)
                for w in words:
                    grows &= w != 0
                yield from batches_of({c: w[grows].view(np.int64) for c, w in zip(names, words)})

    found = map_batches(runs, phrases, ", ".join(f"{c} long" for c in names))
    return found.groupBy(*names).agg(F.count("*").alias("a")).where(F.col("a") >= least)


def wide(c: str | Column) -> Column:
    """Counts times constants may pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def score_of(a: str, l: str | Column, r: str | Column) -> Column:
    over, under = F.lit(SCALE).cast("decimal(8,0)") * wide(a), wide(l) + wide(r)
    return F.call_function("div", over, under)


def bound_of(a: str, word: str) -> Column:
    """No phrase that keeps this word at its outer end and grows from ``a`` occurrences scores more."""
    return score_of(a, a, word)


def joined(rows: DataFrame, side: DataFrame, on: list[str], how: str, small: bool) -> DataFrame:
    return rows.join(F.broadcast(side) if small else side, on, how)


class Growth:
    """Counted phrases by size, and their scores; ``least`` occurrences make a candidate."""

    def __init__(self, words: DataFrame, pairs: DataFrame, least: int):
        self.least = least
        self.words = words
        self.small = {1: words.count() <= BROADCAST_ROWS, 2: pairs.count() <= BROADCAST_ROWS}
        first = words.select("h1", "lang", F.col("f").alias("first"))
        self.of = {2: written(self.ends(joined(pairs, first, ["h1"], "inner", self.small[1]), 2), "phrases")}

    def ends(self, rows: DataFrame, size: int) -> DataFrame:
        last = self.words.select(F.col("h1").alias(H[size - 1]), F.col("f").alias("last"))
        found = joined(rows, last, [H[size - 1]], "inner", self.small[1])
        return found.select("lang", *H[:size], "a", "first", "last")

    def add(self, counted: DataFrame, size: int) -> None:
        first = self.words.select("h1", "lang", F.col("f").alias("first"))
        found = self.ends(joined(counted, first, ["h1"], "inner", self.small[1]), size)
        if size in self.of:  # counts are whole whenever a phrase is counted, so equal phrases are equal rows
            found = self.of[size].unionByName(found).dropDuplicates(list(H[:size]))
        self.of[size] = written(found, "phrases")
        self.small[size] = self.of[size].count() <= BROADCAST_ROWS

    def counts(self, names: tuple[str, ...], to: str) -> DataFrame:
        own = self.of[len(names)]
        return own.select(*[F.col(h).alias(n) for h, n in zip(H, names)], F.col("a").alias(to))

    def scored(self, size: int) -> DataFrame:
        """lang, words, a, and l, r, score of the worst cut. Phrases with an uncounted part are left out:
        they are below the bound of what has grown."""
        rows, cuts = self.of[size], []
        names = H[:size]
        for k in range(1, size):
            l, r = f"l{k}", f"r{k}"
            if k > 1:
                rows = joined(rows, self.counts(names[:k], l), list(names[:k]), "inner", self.small[k])
            if size - k > 1:
                rows = joined(rows, self.counts(names[k:], r), list(names[k:]), "inner", self.small[size - k])
            left, right = F.col("first" if k == 1 else l), F.col("last" if size - k == 1 else r)
            cuts.append(F.struct(score_of("a", left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        worst = F.array_min(F.array(*cuts))
        return rows.select("lang", *names, "a", worst.alias("_w")).select("lang", *names, "a", "_w.l", "_w.r", "_w.score")

    def survivors(self, size: int) -> DataFrame:
        """Scored phrases without those that a phrase longer by a word nearly always holds. A phrase longer by two
        implies one longer by one, with no fewer occurrences."""
        rows = self.scored(size)
        if size == LONGEST or size + 1 not in self.of:
            return rows
        longer, names = self.of[size + 1], list(H[:size])
        sides = [longer.select(*[F.col(H[i + shift]).alias(H[i]) for i in range(size)], F.col("a").alias("_a")) for shift in (0, 1)]
        most = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.max("_a").alias("_most"))
        inside = F.coalesce(F.lit(100) * wide("_most") >= F.lit(80) * wide("a"), F.lit(False))
        return rows.join(most, names, "left").where(~inside).drop("_most")

    def all_survivors(self) -> DataFrame:
        both = [self.survivors(size) for size in sorted(self.of)]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), both)


def level_at(rows: DataFrame, rank: Column | int) -> DataFrame:
    """lang, level: the score of the phrase at that rank of its language, 0 if there are fewer.

    Counts per score come first, so a language has at most 1,000,001 rows here.
    """
    steps = rows.groupBy("lang", "score").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_upto", F.sum("_n").over(above))
    reached = F.max(F.when(F.col("_upto") >= rank, F.col("score")))
    return steps.groupBy("lang").agg(F.coalesce(reached, F.lit(0)).alias("level"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang", seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    rows = texts(docs, text, lang)
    while True:
        counted = word_counts(rows, seed)
        shared = counted.groupBy("h1").agg(F.count("*").alias("_n"), F.max("f").alias("_f"))
        if shared.where((F.col("_n") > 1) & (F.col("_f") >= least)).isEmpty():
            break
        seed += 1
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = written(counted.where(F.col("f") >= least), "frequent-words")
    pairs = pair_counts(rows, seed, marks(words, H[:1]), least)
    runs = pair_runs(rows, seed, marks(pairs, H[:2]))
    growth = Growth(words, pairs, least)
    pair_scores = written(growth.scored(2).select("lang", "score"), "pair-scores")

    never = F.lit(SCALE).cast("long")
    levels = written(pair_scores.select("lang").distinct().select("lang", never.alias("was")), "levels")
    want = 2 * top
    while True:
        # down to the pair at the wanted rank, in languages that are not settled
        levels = levels.join(level_at(pair_scores, want), "lang")
        for size in range(3, LONGEST + 1):
            shorter = growth.of[size - 1].join(levels, "lang")
            opened = lambda word: (bound_of("a", word) >= F.col("level")) & (bound_of("a", word) < F.col("was"))
            names = H[: size - 1]
            right = marks(shorter.where(opened("first")), names)
            left = marks(shorter.where(opened("last")), names)
            growth.add(grown_counts(runs, size, right, left, least), size)
        found = written(growth.all_survivors(), "survivors")
        good = found.join(levels, "lang").where("score >= level").groupBy("lang").agg(F.count("*").alias("_n"))
        left_over = levels.join(good, "lang", "left").where(f"level > 0 AND coalesce(_n, 0) < {top}")
        open_levels = written(left_over.select("lang", F.col("level").alias("was")), "levels")
        if open_levels.isEmpty():
            break
        levels, want = open_levels, 2 * want
    return ranked(found, words, totals, top)


def ranked(found: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score, occurrences and phrase."""
    best = found.join(level_at(found, top), "lang").where("score >= level").drop("level")
    parts = []
    for h in H:
        best = best.join(words.select(F.col("h1").alias(h), F.col("word").alias(f"_{h}")), h, "left")
        parts.append(F.col(f"_{h}"))
    best = best.select("lang", F.concat_ws(" ", *parts).alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = Window.partitionBy("lang", salt).orderBy(*order)
    best = best.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
