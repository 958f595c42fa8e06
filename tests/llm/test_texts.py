"""Shingle join, token counts, toxicity, pages, chats."""

import hashlib
import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row

from checks.compare import connect, difference
from vigilframe.llm import chat, pages, shingle_join, toxicity
from vigilframe.llm.oracle import ORACLE
from vigilframe.llm.queries import QUERIES
from vigilframe.llm.shingle_join import one_of_each, similar_groups
from vigilframe.llm.token_counts import PieceCounter, count_tokens

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_groups(rows, words, percent):
    sets = []
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed=5):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = f"x{rng.randint(0, 9)}"
            rows.append(" ".join(text))
    shared = " ".join(f"common{i}" for i in range(40))
    rows += [f"{shared} {rng.random()} {rng.random()} {rng.random()}" for _ in range(60)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "one two three four", "Ünë two", "ünë two", "a b c d", "long " * 20_000 + "end"]
    rows += rows[:7]
    return [(i, t, "t", 3) for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, sid string, n int"


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_groups(spark, words, percent):
    rows = near_copies()
    found, links = similar_groups(spark.createDataFrame(rows, SCHEMA), words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute_groups(rows, words, percent)
    assert all(got[r.a][1] == got[r.b][1] for r in links.collect())


def test_one_of_each(spark):
    rows = near_copies() + [(5000, "only this one is here twice", "t", 3)] * 2 + [(None, "no id", "t", 3)]
    kept = one_of_each(spark.createDataFrame(rows, SCHEMA), 5, 80)
    assert kept.columns == ["doc_id", "text", "sid", "n"]
    groups = brute_groups(rows[:-3], 5, 80)
    want = sorted([i for i, (_, c) in groups.items() if c == i] + [5000])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1


def test_long_texts_just_below_the_limit_take_few_rounds(spark, monkeypatch):
    """The short sketch is full for such texts, so that every pair of the family is a candidate and fails."""
    family, draw = [], random.Random(3)
    for i in range(60):
        words = [f"w{n}" for n in range(3000)]
        for n in draw.sample(range(3000), 33):
            words[n] = f"own{i}x{n}"
        family.append((i, " ".join(words)))
    family.append((60, family[7][1] + " and a few words more"))
    rounds, sent = [], []
    real, wide = shingle_join.candidates, shingle_join.sketched
    monkeypatch.setattr(shingle_join, "candidates", lambda *a: rounds.append(1) or real(*a))

    def seen(*a):
        near = wide(*a)
        sent.append((near.count(), near.where("near").count()))
        return near

    monkeypatch.setattr(shingle_join, "sketched", seen)
    found = similar_groups(spark.createDataFrame(family, "doc_id long, text string"), 3, 90)[0].collect()
    assert {r.doc_id: r.component_id for r in found} == {**{i: i for i in range(60)}, 60: 7}
    assert len(rounds) <= 3 and sent and all(near * 5 < pairs for pairs, near in sent), (len(rounds), sent)


def test_wide_sketches_never_overstate(spark):
    draw = np.random.default_rng(8)
    for n, m, common in ((0, 3, 0), (5, 9, 5), (800, 900, 700), (40_000, 300, 200), (90_000, 88_000, 80_000)):
        tokens = draw.integers(0, 2**63, n + m - common, dtype=np.uint64)
        a, b = np.unique(tokens[:n]), np.unique(tokens[n - common :])
        bound = shingle_join.parted(shingle_join.wide_sketch(a), shingle_join.wide_sketch(b))
        assert bound <= len(np.setxor1d(a, b)) and (bound > 0) == (len(np.setxor1d(a, b)) > 0)


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert similar_groups(none)[0].collect() == [] and one_of_each(none).collect() == []
    assert count_tokens(none, MODEL).collect() == []
    assert toxicity.toxicity(none, labels).collect() == []
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(messages.withColumn("parts", chat.text_parts("text"))).collect() == []


def test_group_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op2_shingle_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows, 3, 90)


def odd_texts():
    rng = random.Random(1)
    signs = list("ab e  tThE\n\t▁<>/s0x\u0000日本語🙂éñ 　ﬁ\r.…—`'\"123")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return texts + ["", " ", "▁", "\n", "  a ", "<0x0A>", "<s></s>", "the " * 1000, "ab" * 700, "日" * 900 + "the", " " * 1000]


def test_counts_are_the_library_s():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    assert PieceCounter(MODEL).count(texts) == [len(x) for x in library.encode(texts)]


def test_counts_in_spark(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(odd_texts()[-40:])] + [(99, None), (99, None), (100, "word " * 5000)]
    found = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_clauses():
    """Best clause, all clauses, weight a word, best targeted clause, threats."""
    machine = toxicity.Machine({"idiot": 5.0, "schwach*": 3.0, "schwachk*": 4.0})
    best = lambda text: machine.readings_of(text)[1]
    _, denied, quoted = toxicity.LEFT
    assert best("you are an idiot.") == machine.readings_of("you are an idiot.")[4] == 5
    assert best("you are not an idiot.") == 5 * denied < best("he said idiot. fine") == 5 * quoted < 5
    assert best("not so. an idiot") == 5 and machine.readings_of("not so. an idiot")[4] == 0
    assert (best("schwachkopf"), best("schwacher"), best("schwach")) == (4, 3, 0)  # the longest arc
    assert machine.readings_of("I will kill you")[5] > 0 == machine.readings_of("kill time")[5]
    assert machine.readings_of("")[1:] == [0.0] * 5


def plain_readings(text, arcs):
    """The grammar word by word, without machines and their composition."""
    clauses, words = [[]], 0
    for token in toxicity._TOKENS.findall(text):
        if token in ".!?;\n":
            clauses.append([])
        else:
            clauses[-1].append(token.lower())
            words += 1
    sums, targeted, threats = [], [0.0], 0
    for clause in clauses:
        score, since, target, threat, inside, reported = 0.0, 9, False, False, False, False
        for w in clause:
            quote, since = w in toxicity._QUOTES, since + 1
            if w in arcs:
                score += arcs[w] * (0.1 if since <= 3 else 0.4 if inside or reported else 1.0)
            elif quote:
                inside, reported = not inside, False
            elif w in toxicity.THREATS:
                threat = True
            elif w in toxicity.TARGETS:
                target = True
            elif w in toxicity.NEGATIONS:
                since = 0
            elif w in toxicity.REPORTS and not inside:
                reported = True
        sums.append(score)
        if target:
            targeted.append(score)
            threats += threat
    total = sum(sums)
    return [1.0, max(sums), math.log1p(total), 10 * total / (words + 10), max(targeted), math.log1p(threats)]


def test_machine_is_the_grammar():
    rng, arcs = random.Random(8), {"idiot": 5.0, "scum": 3.5}
    stock = ["idiot", "scum", "not", "said", "you", "kill", "word", "fine", ".", "\"", "“", "!", "nicht", "dit", "tu"]
    machine = toxicity.Machine(arcs)
    for _ in range(4000):
        text = " ".join(rng.choices(stock, k=rng.randint(0, 14)))
        assert machine.readings_of(text) == pytest.approx(plain_readings(text, arcs)), text


ORDINARY = [
    "We discussed the distance to the station.",
    "The district train travels through the track.",
    "They trained for the disco contest.",
    "Your loss was a close call, you said.",
    "Die Strecke zum Bahnhof ist lang, und du wirst nicht schlagen müssen.",
    "Schwache Nerven sind kein Hindernis für eine Wanderung.",
    "Le trajet jusqu'à la gare est court et tu es en avance.",
    "El tren llega tarde a la estación y usted puede esperar.",
]


def test_toxicity_after_training(spark):
    """Held-out documents, ordinary sentences, and what denial and report leave of an insult."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    judge = toxicity.train(docs, labels)
    worst = max((w for w in judge.arcs if not w.endswith("*")), key=judge.arcs.get)
    said = [f"you are {worst}.", f"he said you are {worst}.", f"you are not {worst}."]
    rows = spark.createDataFrame(list(enumerate(ORDINARY + said)), "doc_id long, text string")
    scores = [r.score for r in toxicity.score(rows, judge).orderBy("doc_id").collect()]
    assert all(s < 0.5 for s in scores[: len(ORDINARY)])
    plain, reported, denied = scores[len(ORDINARY) :]
    assert plain > reported > denied and plain >= 0.5 > denied
    found = {r.doc_id: r for r in toxicity.score(docs, judge).collect()}
    held = [(found[r.doc_id], r.toxic) for r in labels.where("toxic is not null").where(toxicity.remainder() == 0).collect()]
    assert len(held) > 500 and sum(f.predicted == t for f, t in held) / len(held) > 0.97
    high, low = [f.score for f, t in held if t], [f.score for f, t in held if not t]
    wins = sum((h > l) + (h == l) / 2 for h in high for l in low) / (len(high) * len(low))
    assert wins > 0.94


def test_a_beginning_needs_words_of_its_own(spark):
    texts = [("you disgusting one", 1)] * 9 + [(f"rotten{x} thing", 1) for x in "abcdefghi" * 3] + [("we discuss the rota", 0)] * 60
    rows = spark.createDataFrame([(f"{t} w{i}", y) for i, (t, y) in enumerate(texts)], "text string, toxic int")
    arcs = toxicity.learn_arcs(rows)
    assert "disgusting" in arcs and not any(f.startswith("dis") and f.endswith("*") for f in arcs)
    assert "rotten*" in arcs and "rott*" not in arcs


def test_toxicity_of_odd_rows(spark):
    rows = [(1, None, 5.0), (2, "", 5.0), (2, "", 5.0), (None, "x", 5.0), (3, "word " * 50_000, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in found)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def text_of(page):
    return [b["text"] for b in pages.blocks_of(page) if not b["out"]]


def test_blocks():
    assert text_of("<p>a &amp; b<p>c<br>d") == ["a & b", "c d"]
    assert text_of("plain") == ["plain"] and text_of("") == []
    assert text_of("<ul><li>one<li>two</ul>x<b>y</b> z") == ["one", "two", "xy z"]
    assert text_of("<p>a <span class='ad'>buy</span> b</p>") == ["a b"]
    assert text_of('<div class="cookie-notice"><p>x</p></div><p title="a > b">y</p>') == ["y"]
    assert text_of("<script>if (a<b) '</p>'</script><p>t</p><!-- <p>no</p> --><style>p{}</style>") == ["t"]
    assert text_of("<head><title>t</title><body><p>x") == ["x"]
    assert text_of("<header>site</header><article><header><h1>Title</h1></header>text</article>") == ["Title", "text"]
    assert text_of("<p>a < b and <unclosed") == ["a < b and <unclosed"]
    assert text_of("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert text_of("<script>never closed <p>x") == []
    assert text_of("<section id=comments><article><p>me too</article></section><article>news</article>") == ["news"]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div>" * 200_000 + "deep", ["deep"]),
        ("<div><p>" * 100_000 + "deep" + "</p></div>" * 100_000, ["deep"]),
        ("<p>word</p>" + '<a "' * 250_000, ["word", '<a "' * 249_999 + '<a "']),
        ("<p>word" + "<a x=\"" * 150_000 + "'>", None),
        ("x<button>no</button>" * 50_000, ["x" * 50_000]),
        ("</b></div>" * 100_000 + "end", ["end"]),
        ("<ul>" + "<li>a" * 150_000, ["a"] * 150_000),
        ("<b>" * 300_000 + "x" + "</i>" * 100_000, ["x"]),
        ("<script" * 120_000, ["<script" * 120_000]),
        ("<" * 1_000_000, ["<" * 1_000_000]),
        ("<p><math><mi>x</mi></math> is one", ["x is one"]),
    ],
)
def test_any_page_takes_its_size(page, text):
    start = time.process_time()
    found = text_of(page)
    assert time.process_time() - start < 12 and (text is None or found == text)


def test_style_tree_removes_what_returns(spark):
    page = "<div class=top>Welcome to our house</div><div class=body><p>{}</p><p>{}</p></div><div class=x{}>Same words</div>"
    rows = [(i, "http://h.example/" + str(i), page.format(f"text {i} " * 9, f"more {i}" * 9, "")) for i in range(9)]
    rows += [(20, "http://h.example/20", rows[0][2])] * 3  # copies say nothing
    rows += [(30 + i, f"http://one{i}.example/", page.format("alone", "again", "")) for i in range(3)]
    rows += [(40, None, None), (41, "x", ""), (42, "odd", "<article><p>only</p></article><p>rest</p>")]
    found = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3].text == ("text 3 " * 9).strip() + "\n" + "more 3" * 9 and found[3].blocks_removed == 2
    assert found[30].text == "Welcome to our house\nalone\nagain\nSame words"
    assert found[40].text == found[41].text == "" and found[40].n_chars == 0 and found[42].text == "only"


def test_pages_query(spark):
    import html
    import re

    found = {r.page_id: r for r in QUERIES["op10_html"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        article = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", article)]
        assert found[r.page_id].text == "\n".join(b for b in blocks if b)
    assert len(found) == len(rows)


HOSTILE = ["<|turn|>", "<\\|turn|>", "</s>", "[INST]x[/INST]", "a<", "<<s>", "<|en", "d|>", "\\", "[\\\\/INST]", "", None]


def test_chats_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "<|body|>", None]), "".join(x or "" for x in rng.choices(HOSTILE, k=3))))
    rows += [(50, 1, "assistant", None), (50, None, "system", "first"), (50, 1, "assistant", None), (None, 0, "user", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(messages.withColumn("parts", chat.text_parts("text")))
    got = {r.conv_id: r for r in chat.chat_digest(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        said = "".join(x for _, r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(said))


def test_content_parts(spark):
    part = lambda kind, **k: Row(kind=kind, text=k.get("text"), ref=k.get("ref"), width=k.get("width"), height=k.get("height"), seconds=k.get("seconds"), pages=k.get("pages"))
    parts = [
        part("text", text="<|im"),
        part("text", text="age|>"),
        part("image", ref="a.png", width=56, height=29),
        part("audio", ref="b.wav", seconds=2.0),
        part("document", ref="c.pdf", pages=2),
        part("hologram", text="as text"),
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.format_chats(frame).first()
    assert got.formatted == (
        "<|turn|>user<|body|><|im<|part|>age|><|image|><|audio|><|document|>as text<|end|>"
        "<|turn|>assistant<|body|><|end|><|turn|>assistant<|body|><|end|>"
    )
    assert [(a.kind, a.ref, a.tokens) for a in got.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 25), ("document", "c.pdf", 1280)]
    assert got.attachment_tokens == 1309 and len(got.loss_spans) == 2


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None
