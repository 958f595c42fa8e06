"""The stages of the pipeline on the smallest table, each held against what its operator says."""

import itertools
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_documents import highest_quotients, targets_by_hand
from test_texts import brute_groups
from tokenizers import Tokenizer

from vigilframe.llm.common import table, written
from vigilframe.llm.mixing import mix
from vigilframe.llm.shingle_join import similar_groups
from vigilframe.llm.toxicity import score, train

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "n_chars AS score")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "mixing", "packing"]

    clean = written(stages["toxicity"](spark, docs, SF), "test")
    scores = score(docs, train(docs, table(spark, SF, "labels"))).where("predicted = 0")
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(r.doc_id for r in scores.collect())
    assert clean.columns == columns and clean.join(docs, columns, "left_anti").isEmpty()

    single = written(stages["near_duplicates"](spark, clean, SF), "test")
    groups = similar_groups(clean, 5, 80)[0].collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    assert single.columns == columns

    mixture = written(stages["mixing"](spark, single, SF), "test")
    words = sum(len(r.text.split()) for r in mixture.collect())
    assert words == sum(r.taken for r in mix(single).collect()) and mixture.columns == columns

    pieces = stages["packing"](spark, mixture, SF).collect()
    assert all(len(p.ids) == p.length for p in pieces)
    tokens = {}
    for p in pieces:
        tokens[p.sequence_id] = tokens.get(p.sequence_id, 0) + p.length
    assert all(n == 2048 for s, n in tokens.items() if s != max(tokens))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_planted_copies_leave_one(spark):
    words = [f"word{i}" for i in range(200)]
    near = words[:50] + ["changed"] + words[51:]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(near)), (4, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def planted(seed=3):
    """(doc_id, text, source), the toxic ids and the labelled ids."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("bdgklmnprstaeiou") for _ in range(6)) for _ in range(2000)]
    plain = lambda n: " ".join(rng.choice(known) for _ in range(n))
    texts, toxic = [], set()
    for i in range(360):
        if i % 3 == 0:
            toxic.add(i)
            texts.append(f"{plain(20)}.\nYou are a stinking blockhead! {plain(rng.randint(5, 40))}")
        elif i % 7 == 0 and i > 20:
            copy = next(texts[j] for j in range(i - 10, 0, -1) if j not in toxic).split(" ")
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        else:
            texts.append(f"{plain(rng.randint(1, 200))}\n\n{plain(rng.randint(1, 200))}")
    texts += [None, "", " \n", "one <|endoftext|> two", "日本語 🙂\t" * 40]
    rows = [(i, t, [None, "a", "b", "b", "c", "c", "c", "c"][rng.randrange(8)]) for i, t in enumerate(texts)]
    return rows, toxic, range(270)


def mixture_by_hand(rows, hashes):
    """The texts of the mixture as (doc_id, text), from the method's definition."""
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words[i])
    targets = targets_by_hand(sizes)
    sources = sorted(sizes, key=lambda s: "n" if s is None else f"v{s}")
    seats = highest_quotients([targets[s] for s in sources], round(sum(targets.values())))
    out = []
    for source, quota in zip(sources, seats):
        size = sizes[source]
        blocks, quota = math.ceil(size / 32), min(quota, 2 * size)
        draw = np.random.default_rng([0, *("n" if source is None else f"v{source}").encode()])
        a = int(draw.integers(1, 2**20))
        while blocks and math.gcd(a, blocks) != 1:
            a += 1
        c = int(draw.integers(0, max(1, blocks)))
        taken = set()  # (pass, place in the line of words)
        for number in range(2):
            ahead = number * size
            for k in sorted(range(blocks), key=lambda k: (a * k + c) % blocks):
                for x in range(32 * k, min(32 * k + 32, size)):
                    if ahead < quota:
                        taken.add((number, x))
                    ahead += 1
        at = 0
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: hashes[r[0]]):
            spots = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
            for number in range(2):
                own = [j for j in range(len(spots)) if (number, at + j) in taken]
                runs = [[j for _, j in g] for _, g in itertools.groupby(enumerate(own), key=lambda e: e[1] - e[0])]
                for run in runs:
                    part = text.encode()[spots[run[0]][0] : spots[run[-1]][1]].decode()
                    out.append((i, text if len(run) == len(spots) else part))
            at += len(spots)
    return out


def test_run_by_brute_force(spark, tmp_path):
    rows, toxic, labelled = planted()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in labelled], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    clean = [r for r in rows if r[0] not in toxic]
    groups = brute_groups(clean, 5, 80)
    single = [r for r in clean if groups[r[0]][1] == r[0]]
    assert 20 < len(clean) - len(single) < 60
    order = docs.select("doc_id", F.xxhash64(F.lit(0), "doc_id", F.xxhash64("text")).alias("h"))
    mixture = mixture_by_hand(single, {r.doc_id: r.h for r in order.collect()})
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, (*coder.encode(t, add_special_tokens=False).ids, 1)) for i, t in mixture)

    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (p.sequence_id, p.offset))
    found, place = [], 0
    for p in pieces:
        assert (p.sequence_id, p.offset) == divmod(place, 2048) and p.length == len(p.ids)
        place += p.length
        if p.start == 0:
            found.append((p.doc_id, []))
        assert p.doc_id == found[-1][0] and p.start == len(found[-1][1])
        found[-1][1].extend(p.ids)
        assert p.offset + p.length <= 2048 and (p.start + p.length == p.doc_tokens or p.offset + p.length == 2048)
    assert Counter((i, tuple(ids)) for i, ids in found) == want
