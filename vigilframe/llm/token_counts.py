"""Token counts of whole texts under a piece vocabulary, by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens that no piece can span. The pre-tokens of a batch that were not met before
stand in one flat numpy array of symbols; in every step each of them merges its lowest-ranked pair (the
leftmost of equals), all at the same time, until none has a pair left. Surviving symbols are counted;
characters outside the vocabulary count their UTF-8 bytes.

The model file is read for its pieces and scores only. Defined cases: null and empty texts have 0 bytes and
0 tokens; control strings and byte names inside texts are ordinary text; a row without a count never
occurs; repeated rows are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import map_texts

LIMIT = 4096
SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
#: Longer pre-tokens (no blank in so many characters) merge one by one with a heap: a step per merge over the
#: whole pre-token would be quadratic.
LONG = 256
#: Pre-tokens whose counts a task remembers, and characters that it merges at a time.
REMEMBERED, CHUNK = 400_000, 1 << 20


class PieceCounter:
    """Counts the pieces that byte-pair merging by score leaves of a text."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces, scores = [], []
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        ids = {p: i for i, p in enumerate(pieces)}
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        for char in sorted({c for p in pieces for c in p} - ids.keys()):  # only parts of pieces
            ids[char] = len(ids)
        unknown = len(ids)  # four more, by length in UTF-8
        self.cost = np.ones(unknown + 4, dtype=np.int64)
        self.symbol_of = np.full(0x110000, unknown + 2, dtype=np.int32)
        self.symbol_of[:0x80], self.symbol_of[0x80:0x800] = unknown, unknown + 1
        self.symbol_of[0x10000:] = unknown + 3
        self.cost[unknown:] = [1, 2, 3, 4]
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
                if i >= len(pieces):
                    self.cost[i] = len(p.encode())
        self.width = unknown + 4
        pairs = {}
        for p, score in zip(pieces, scores):
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (order[score], ids[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NO_RANK], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], dtype=np.int32)
        spans_space = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        alone = "" if any("\n" in p for p in pieces) else "\n"
        own = f"{SPACE}{alone}"
        self.cutter = re.compile(
            "(?s).+" if spans_space else f"{SPACE}*[^{own}]+|{SPACE}+" + (f"|{alone}" if alone else "")
        )
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self.cutter.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table; the last place is for pairs that don't merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def survivors(self, tokens: list[str]) -> np.ndarray:
        """Pieces of every pre-token, merged in step."""
        total = np.zeros(len(tokens), dtype=np.int64)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        symbols = self.symbol_of[np.frombuffer("".join(tokens).encode("utf-32-le"), dtype=np.uint32)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        at = np.full(len(symbols), len(self.keys), dtype=np.int64)
        at[:-1] = np.where(owner[:-1] == owner[1:], self.pair(symbols[:-1], symbols[1:]), len(self.keys))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            rank = self.ranks[at]
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_RANK
            if over.any():
                gone = np.repeat(over, sizes)
                np.add.at(total, owner[gone], self.cost[symbols[gone]])
                symbols, owner, at, rank = symbols[~gone], owner[~gone], at[~gone], rank[~gone]
                sizes, best = sizes[~over], best[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # the leftmost of each pre-token
            symbols[hits] = self.merged[at[hits]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[hits + 1] = False
            where = np.cumsum(stay)[hits] - 1
            symbols, owner, at = symbols[stay], owner[stay], at[stay]
            for i in (where, where[where > 0] - 1):  # pairs that have a new member
                i = np.unique(i)
                j = np.minimum(i + 1, len(symbols) - 1)
                inside = (j > i) & (owner[i] == owner[j])
                at[i] = np.where(inside, self.pair(symbols[i], symbols[j]), len(self.keys))
        return total

    def survivors_of_long(self, token: str) -> int:
        symbols = self.symbol_of[np.frombuffer(token.encode("utf-32-le"), dtype=np.uint32)].tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        queue: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(symbols):
                if found := table.get(symbols[i] * self.width + symbols[j]):
                    heapq.heappush(queue, (found[0], i, symbols[i], j, symbols[j], found[1]))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, left, j, right, new = heapq.heappop(queue)
            if symbols[i] != left or after[i] != j or symbols[j] != right:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return int(self.cost[[s for s in symbols if s >= 0]].sum())

    def learn(self, tokens: Iterable[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        for t in new:
            if len(t) > LONG:
                self.known[t] = self.survivors_of_long(t)
        new = [t for t in new if len(t) <= LONG]
        self.known.update(zip(new, self.survivors(new).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            cut = [self.pre_tokens(t) for t in texts[start:end]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.learn({t for tokens in cut for t in tokens})
            look = self.known.__getitem__
            out += [sum(map(look, tokens)) for tokens in cut]
            start = end
        return out


def count_tokens(
    docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT
) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit per row. ``model_file`` must be readable on every executor."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(model_file)
        for frame in frames:
            frame["n_tokens"] = np.array(counter.count(frame.pop("_text").tolist()), dtype=np.int64)
            yield frame

    rows = docs.select(
        F.col(key).alias("_key"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    kind = rows.schema["_key"].dataType.simpleString()
    counted = map_texts(rows, batches, f"_key {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
