"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a word ends in one token only, and what stands before that token is the encoding of the
shorter prefix. So it is enough to know the last token of every prefix: an automaton with suffix links names
all tokens that end at a place, and the one that fits is the one whose pair with the last token of the prefix
before it would not merge across their border. The ids are read off by following the last tokens back. A word
takes time in proportion to its length times the tokens that end at one place; there is no merge loop.

Whether two tokens stand side by side is decided on the edges of their merge trees: each symbol on the right
edge of the left one, and on the left edge of the right one, exists from the merge that made it to the merge
that used it up, and a pair of symbols that exist together must not have a merge in that time.

Defined cases: null and empty texts have no ids and decode to the empty text; strings of special tokens inside
a text are these tokens; characters of any script go through their UTF-8 bytes; a text or word of any length is
taken whole; repeated rows are encoded each; an empty table gives an empty table; other columns are not looked
at. A vocabulary with rules that this module does not know is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import map_texts

#: Words, runs without white space and pairs of tokens that a task remembers.
REMEMBERED = 300_000
#: Longer runs are not remembered.
LONG = 100
#: Characters of texts that a worker holds encoded before it hands them on.
HELD = 1 << 20
#: White space as Unicode has it (Python's own class has four controls more).
WHITE = "\t-\r \x85\xa0  -     　"
#: Above this, Unicode versions and composition matter and the library's own rules decide.
PLAIN = re.compile("[^̀-\U0010ffff]*")
NEVER = 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it can be printed, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Merges:
    """Ranked merges of a vocabulary as trees, and which tokens can stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = vocabulary[left], vocabulary[right]
            token = vocabulary[left + right]
            if token in self.parts or self.rank.get(a, -1) >= rank or self.rank.get(b, -1) >= rank:
                raise ValueError(f"merge {rank} is not in the order of a trained vocabulary")
            self.parts[token], self.rank[token], self.pairs[a, b] = (a, b), rank, rank
        made = {v for v in vocabulary.values() if v in self.parts}
        self.base = {t: v for t, v in vocabulary.items() if v not in made and len(t.removesuffix(suffix) or t) == 1}
        # a token is met only if no merge across the border of its parts comes before its own
        self.edges: dict[int, tuple[list, list]] = {}
        self.alive = set(self.base.values())
        for token, (a, b) in self.parts.items():
            if a in self.alive and b in self.alive and not self.crossed(a, b, self.rank[token]):
                self.alive.add(token)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, merge that uses it up) from the token down one side of its tree to its first symbol."""
        if token not in self.edges:
            both: list[list] = [[], []]
            for way in (0, 1):
                at, until = token, NEVER
                while True:
                    both[way].append((at, until))
                    if at not in self.parts:
                        break
                    until = self.rank[at]
                    at = self.parts[at][way]
            self.edges[token] = both[0], both[1]
        return self.edges[token][side]

    def crossed(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether symbols of ``a`` and ``b`` merge with each other before that rank."""
        left, right = self.edge(a, 1), self.edge(b, 0)
        i, j = len(left) - 1, len(right) - 1
        while i >= 0 and j >= 0:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.pairs.get((x, y), NEVER)
            # of equal pairs the left one merges first
            if rank < before and rank < x_until and rank <= y_until:
                return True
            if x_until <= y_until:
                i -= 1
            if y_until <= x_until:
                j -= 1
        return False


class PrefixCoder:
    """Ids of whole texts as the ``tokenizers`` library gives them without added special tokens."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.check(spec)
        suffix = model["end_of_word_suffix"]
        merges = Merges(model["vocab"], model["merges"], suffix)
        # bytes as characters below 256, the last byte of a word 256 higher
        signs = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = ahocorasick.Automaton()
        for text, token in model["vocab"].items():
            if token in merges.alive:
                body = text.removesuffix(suffix) or text
                end = len(body) < len(text)
                codes = [signs[c] for c in body]
                codes[-1] += 256 * end
                self.tokens.add_word("".join(map(chr, codes)), (token, len(codes)))
        if len(merges.base) != 512:
            raise ValueError("every byte needs a symbol, inside and at the end of a word")
        self.tokens.make_automaton()
        self.merges = merges
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.runs = re.compile(f"[^{WHITE}]+")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.normalizer = Tokenizer.from_file(vocabulary).normalizer
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.of_run: dict[str, bytes] = {}
        self.of_word: dict[str, bytes] = {}
        self.stands: dict[int, bool] = {}

    @staticmethod
    def check(spec: dict) -> None:
        model, pre = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        fits = (
            model["type"] == "BPE"
            and model["end_of_word_suffix"]
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and spec["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            # words hold no white space, so runs between white space can be taken one by one
            and pre[0]["pattern"]["Regex"].endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not fits:
            raise ValueError("this vocabulary needs rules that the coder does not have")

    def last_tokens(self, word: str) -> list[int]:
        """Ids of one word: the last token of each prefix, followed back from the end."""
        raw = word.encode()
        signs = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last = [-1] * (len(signs) + 1)
        size = [0] * (len(signs) + 1)
        stands, crossed = self.stands, self.merges.crossed
        for end, (token, length) in self.tokens.iter(signs):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if length < end:
                pair = before << 32 | token
                fits = stands.get(pair)
                if fits is None:
                    if len(stands) > 4 * REMEMBERED:
                        stands.clear()
                    fits = stands[pair] = not crossed(before, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
        ids, at = [], len(signs)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def run(self, run: str) -> bytes:
        """Ids of characters without white space: normalised, cut into words, each encoded."""
        if PLAIN.fullmatch(run):
            words = self.words.findall(run.lower())
        else:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(run))]
        out = []
        for word in words:
            found = self.of_word.get(word)
            if found is None:
                found = np.array(self.last_tokens(word), dtype="<u4").tobytes()
                if len(word) <= LONG:
                    if len(self.of_word) >= REMEMBERED:
                        self.of_word.clear()
                    self.of_word[word] = found
            out.append(found)
        return b"".join(out)

    def segment(self, text: str) -> bytes:
        runs = self.runs.findall(text)
        known, out = self.of_run, []
        for run in runs:
            found = known.get(run)
            if found is None:
                found = self.run(run)
                if len(run) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[run] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.segment(text)
        return b"".join(
            np.array([self.special[part]], dtype="<u4").tobytes() if part in self.special else self.segment(part)
            for part in self.cut.split(text)
        )


class PieceDecoder:
    """Texts of ids, special tokens kept: the tokens' own strings, joined as the vocabulary says."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["decoder"] is not None:
            raise ValueError("this vocabulary needs a decoder that this module does not have")
        texts = {v: t for t, v in spec["model"]["vocab"].items()}
        texts.update({t["id"]: t["content"] for t in spec["added_tokens"]})
        self.text = texts.__getitem__

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.text, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens and ids (binary, little-endian unsigned 32-bit) of every text.

    ``vocabulary`` must be readable on every executor.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = PrefixCoder(vocabulary)
        for frame in frames:
            for part in portions(frame, frame["_text"].str.len()):
                ids = [coder.encode(t) for t in part.pop("_text")]
                yield part.assign(ids=pd.Series(ids, index=part.index, dtype=object))

    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    coded = map_texts(rows, batches, f"_key {kind}, ids binary")
    return coded.select(F.col("_key").alias(key), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode_ids(coded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """All columns of ``coded`` and ``decoded``, the text of its ids; null where these are null."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = PieceDecoder(vocabulary)
        for frame in frames:
            for part in portions(frame, frame[ids].str.len().fillna(0)):
                texts = [None if raw is None else decoder.decode(raw) for raw in part[ids]]
                yield part.assign(decoded=pd.Series(texts, index=part.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields if f.name != "decoded")
    return map_texts(coded.drop("decoded"), batches, f"{schema}, decoded string")


def portions(frame: pd.DataFrame, sizes: pd.Series) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most HELD characters together, or one longer row."""
    block = (sizes.cumsum() // HELD).to_numpy()
    for _, part in frame.groupby(block, sort=False):
        yield part


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    both = decode_ids(encode_texts(docs, vocabulary), vocabulary)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
