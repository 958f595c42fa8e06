"""Best-first growth against counting everything."""

import random
import re
from collections import Counter

import pytest

from checks.compare import connect, difference
from vigilframe.llm import collocations as c
from vigilframe.llm.oracle import ORACLE
from vigilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, h1 int, a long"


def brute(rows, top, least):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    good = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    dropped = set()
    for (lang, *w), n in good.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, *w[i : i + size])
                if 100 * n >= 80 * good[part]:
                    dropped.add(part)
    found = {}
    for p, n in good.items():
        if p not in dropped:
            lang, *w = p
            cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * n // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
            found.setdefault(lang, []).append((-score, -n, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i + 1, w.decode(), -n, left, right, total[lang], -s)
        for lang, rows in found.items()
        for i, (s, n, w, left, right) in enumerate(sorted(rows)[:top])
    )


def made(seed=3, n=900):
    """Phrases inside phrases, words that stand in most phrases, ties, languages of different size."""
    rng = random.Random(seed)
    common = ["the", "of", "And", "to"]
    stock = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(2, 6))] for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(1, 12)):
            words += rng.choice(stock) if rng.random() < 0.7 else [rng.choice(common)]
            if rng.random() < 0.25:
                words[-1] += rng.choice(".,;:!?\n\r\x0b\x0c")
        rows.append((i, rng.choice([" ", "\t", "  "]).join(words), rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [(None, "only once here", "xx"), (1, None, "en"), (2, "", "en"), (3, "...", None), (4, " \x1c \x85 é É", "en")]
    return rows + [(5, "same same same same same " * 40, "same")] * 3 + [(6, "of the of the " * 9000, "long")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("top,least", [(2000, 5), (3, 5), (25, 30), (1, 2)])
def test_against_counting_everything(spark, top, least):
    rows = made()
    found = c.collocations(table(spark, rows), top, least)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, top, least)


def test_little_memory(spark, monkeypatch):
    """Chunks of a few words, words forgotten at once."""
    for name, value in (("CHUNK", 64), ("REMEMBERED", 10), ("ROWS", 7)):
        monkeypatch.setattr(c, name, value)
    rows = made(9, 200)
    assert sorted(map(tuple, c.collocations(table(spark, rows), 10, 3).collect())) == brute(rows, 10, 3)


def test_collisions_take_another_seed(spark, monkeypatch):
    tried = []
    real = c.word_counts

    def counted(rows, seed):
        tried.append(seed)
        found = real(rows, seed)
        return found.withColumn("h1", found.h1 % 3) if seed == 0 else found

    monkeypatch.setattr(c, "word_counts", counted)
    rows = made(4, 200)
    assert sorted(map(tuple, c.collocations(table(spark, rows), 10, 3).collect())) == brute(rows, 10, 3)
    assert tried == [0, 1]


def test_no_documents(spark):
    assert c.collocations(table(spark, [])).collect() == []
    assert c.collocations(table(spark, [(1, None, None)])).collect() == []


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    assert difference(QUERIES["op12_collocations"](spark, sf), connect(sf), ORACLE["op12_collocations"]) is None
