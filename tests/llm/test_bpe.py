"""Encoding by prefixes against the tokenizers library, and decoding."""

import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilframe.llm import bpe
from vigilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(FILE)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def coder():
    return bpe.PrefixCoder(FILE)


def odd_texts():
    rng = random.Random(1)
    signs = list("abehin tThE'sS re\n\t/0x日本語🙂éñ 　ﬁ\r.…—`'\"123́̀İΣσς\x1c\x1f\x85한글각กำनि՘₏")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    words = "".join(rng.choice("etaoinshrdlu") for _ in range(40_000))
    texts += [words[i : i + rng.randint(1, 14)] for i in range(0, 40_000, 9)]
    texts += ["", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|> b<|endoftext|", "<|ENDOFTEXT|>"]
    return texts + ["x" * 20_000, "ab" * 9000, "ababaaabab" * 500, "日" * 3000, "!" * 5000, "é" * 3000, " ́a"]


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_and_texts_are_the_library_s(library, coder):
    decoder = bpe.PieceDecoder(FILE)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        raw = coder.encode(text)
        assert ids(raw) == want, text[:80]
        assert decoder.decode(raw) == library.decode(want, skip_special_tokens=False)


def test_every_character(library, coder):
    for start in range(0, 0x110000, 0x1100):
        text = "".join(chr(c) for c in range(start, start + 0x1100) if not 0xD800 <= c < 0xE000)
        assert ids(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_pairs_stand_as_merging_says(coder):
    """Two tokens are compatible where merging all their symbols by rank gives the two again."""
    merges = coder.merges
    body = lambda t: [t] if t not in merges.parts else [s for p in merges.parts[t] for s in body(p)]

    def merged(symbols):
        while True:
            found = [(merges.pairs.get(p, bpe.NEVER), i) for i, p in enumerate(itertools.pairwise(symbols))]
            rank, i = min(found, default=(bpe.NEVER, 0))
            if rank == bpe.NEVER:
                return symbols
            symbols[i : i + 2] = [made[tuple(symbols[i : i + 2])]]

    made = {p: t for t, p in merges.parts.items()}
    rng = random.Random(2)
    inner = [t for t in sorted(merges.alive) if t >= 512][:8000]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(inner)
        if a not in merges.alive or b not in merges.alive:
            continue
        assert merges.crossed(a, b) == (merged(body(a) + body(b)) != [a, b])


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.PrefixCoder(public_tokenizers.path("byte_bpe_50k.json"))
    with open(FILE, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["dropout"] = 0.1
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.PrefixCoder(str(tmp_path / "v.json"))


def test_tables(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts()[-20:])] + [(None, None, "x", 1), (3, None, None, None), (3, "two", "x", 2)]
    rows.append((77, "a long text " * 40_000, "x", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = bpe.encode_texts(docs, FILE)
    want = sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    got = [(r.doc_id, r.n_tokens, ids(bytes(r.ids))) for r in found.collect()]
    coded = [library.encode(t, add_special_tokens=False).ids for _, t in want]
    assert sorted(got, key=str) == sorted(((i, len(c), c) for (i, _), c in zip(want, coded)), key=str)
    texts = [r.decoded for r in bpe.decode_ids(found.withColumn("decoded", F.lit(1)), FILE).collect()]
    assert sorted(texts) == sorted(library.decode(c, skip_special_tokens=False) for c in coded)
    assert bpe.round_trip(docs.limit(0), FILE).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decode_ids(nothing, FILE).collect()] == [None]


def test_query(spark, library):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        found = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(found, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        want.append((r.doc_id, len(found), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op13_bpe"](spark, SF).collect())) == sorted(want)
