"""Packing by concatenating and cutting: token totals of partitions give every document its global place.

Pass one tokenizes every partition into a table with running token counts; a sum over one total per partition
gives the offsets; pass two cuts the endless line into windows of fixed length. A document that crosses a
window's end leaves a record on either side. Only the last window has padding. No row is shuffled.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; an empty table
gives an empty table; a text of any length is cut as often as needed. Retried tasks give the same pieces, as
pass two reads what pass one has written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import map_texts, written

WINDOW, END = 2048, 1
#: Characters that are tokenized at a time.
CHUNK = 1 << 20
#: Pieces that a worker holds ready before it hands them on.
HELD = 512
#: tiktoken panics on runs of white space above a million characters; longer runs than this are encoded apart.
RUN = 100_000
#: White space as the pattern of a vocabulary has it (Python's own class has four controls more).
BLANK_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class ByteTokenizer:
    """Ids as ``tokenizers`` gives them for ``vocabulary`` without added special tokens.

    ``ranks`` is the same vocabulary for tiktoken, which is four times as fast; it takes every text that has
    none of the vocabulary's special strings in it. ``pattern`` takes a run of white space as one piece, but for
    its last character if something follows, as GPT-2's does; long runs rely on that.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.type = np.uint16 if self.slow.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.ordinary(text)
        return np.array([*found, END], dtype=self.type)

    def ordinary(self, text: str) -> list[int]:
        found, at = [], 0
        for run in BLANK_RUN.finditer(text) if len(text) > RUN else ():
            if run.end() - run.start() > RUN:
                end = run.end() - (run.end() < len(text))
                found += self.fast.encode_ordinary(text[at : run.start()])
                found += self.piece.encode_ordinary(text[run.start() : end])
                at = end
        return found + self.fast.encode_ordinary(text[at:])


def tokenized(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id"
) -> DataFrame:
    """Pass one, written: part, before (tokens before, in the part), the key, n and ids (little endian)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        coder = ByteTokenizer(vocabulary, ranks, pattern)
        for frame in frames:
            texts, keys = frame["_text"].tolist(), frame["_key"].tolist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                found = [coder.ids(t) for t in texts[start:end]]
                n = np.array([len(x) for x in found], dtype=np.int64)
                yield pd.DataFrame(
                    {
                        "part": part,
                        "before": before + np.cumsum(n) - n,
                        "_key": pd.Series(keys[start:end], dtype=frame["_key"].dtype),
                        "n": n,
                        "wide": coder.type is np.uint32,
                        "ids": [x.tobytes() for x in found],
                    }
                )
                before += int(n.sum())
                start = end

    rows = docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"part int, before long, _key {kind}, n long, wide boolean, ids binary"
    return written(map_texts(rows, batches, schema), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """First global place of each part: one row per partition that pass one had."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("_total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return totals.select("part", (F.sum("_total").over(order) - F.col("_total")).alias("first"))


def cut_windows(tokens: DataFrame, window: int = WINDOW, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Pass two: a row per piece, with its ids (``array<int>``) if asked for."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, place, n, wide, raw in zip(
                frame["_key"], (frame["first"] + frame["before"]).tolist(), frame["n"].tolist(), frame["wide"], frame["ids"]
            ):
                ids = np.frombuffer(raw, dtype=np.uint32 if wide else np.uint16).astype("<u4")
                cuts = [0, *range(window - place % window, n, window), n]
                for a, b in zip(cuts, cuts[1:]):
                    piece = ids[a:b]
                    at = place + a
                    row = (k, a, b - a, zlib.crc32(piece.tobytes()), n, at // window, at % window)
                    out.append((*row, piece.astype(np.int32)) if with_ids else row)
                if len(out) >= HELD:
                    yield pd.DataFrame(out, columns=names).astype({"_key": frame["_key"].dtype})
                    out = []
            yield pd.DataFrame(out, columns=names).astype({"_key": frame["_key"].dtype})

    names = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind = tokens.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in names[1:7]) + (", ids array<int>" if with_ids else "")
    # one row of 12 bytes per partition of pass one
    placed = tokens.join(F.broadcast(offsets(tokens)), "part").select("_key", "first", "before", "n", "wide", "ids")
    return map_texts(placed, batches, schema).withColumnRenamed("_key", key)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, **options) -> DataFrame:
    return cut_windows(tokenized(docs, vocabulary, ranks, pattern), **options)


def sequences(pieces: DataFrame, window: int = WINDOW, padding: int = 0) -> DataFrame:
    """The windows themselves: sequence_id, ids (padded), n (ids before padding) and where documents start."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "start", "ids")))  # at most ``window`` pieces
    return (
        pieces.groupBy("sequence_id")
        .agg(ordered.alias("_pieces"))
        .select(
            "sequence_id",
            F.flatten(F.transform("_pieces", lambda p: p["ids"])).alias("ids"),
            F.transform("_pieces", lambda p: p["offset"]).alias("piece_offsets"),
        )
        .withColumn("n", F.size("ids"))
        .withColumn("ids", F.concat("ids", F.array_repeat(F.lit(padding), F.lit(window) - F.col("n"))))
    )
