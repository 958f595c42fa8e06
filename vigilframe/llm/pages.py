"""Main text of web pages by site style trees.

Every page is read into blocks of text; a block hangs on a style node, the path of block elements with their
classes. The pages of a host are merged into one tree: for each node the pages that have it, the texts on it
and the child styles under it. A node's importance is made of two entropies: texts that return on page after
page make it unimportant, and so does a presentation that never varies. Blocks on nodes of low importance are
removed from each page, and with the last block of a branch the branch is gone.

A site of few pages says little, and copies of one page say nothing about their site. So equal pages of a host
count once, a host needs MIN_PAGES different ones before anything is removed by entropy, headings and the
node that carries most of a page's text stay, and what HTML itself declares not to be the article (navigation,
footers, forms, scripts, advert and comment classes and so on) goes in any case. Where a page has an article
or main element, its text is all that counts.

Defined cases: null and empty pages have an empty text; a null or odd url makes a page of the host "";
repeated rows are pages of their own; white space is any Unicode white space; unclosed tags, comments and
quotes end as browsers end them; an empty table gives an empty table. No text is cut.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import map_texts, written

#: Importance below which a node goes, weight of the children, different pages that a host must have.
LOW, GAMMA, MIN_PAGES = 0.3, 0.9, 4
#: Hosts whose lists are broadcast at most, and parts that a host is dealt into beyond that.
BROADCAST_HOSTS, SALTS = 200_000, 64

# fixed values: elements of HTML
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol "
    "optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
_OUT = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input label map menu nav noframes "
    "noscript object search select svg template video".split()
)
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup"}
#: An opening tag ends open tags of the first set, up to the nearest of the second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Words in classes, ids and roles of what is not the article.
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription taboola teaser toolbar tooltip topbar widget widgets".split()
)
_PAGE_HEADER = frozenset("header hdr head".split())
#: Names with such a word speak of what surrounds or contains the rest.
_AROUND = frozenset("has no with without main content".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
#: Where a tag's quotes don't close before the end of the page, the rest of the page is read without regard to quotes.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_TAG_START = re.compile("</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[a-z]+")


def _signed(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31 | zlib.crc32(data, 0x5EED) >> 1) - 2**62


class _Element:
    """An open element. ``node`` numbers the styles from the root to it, ``name`` is the last of their tags.
    ``saved`` is the text before an inline element that is left out: it goes on after it."""

    __slots__ = ("tag", "node", "name", "main", "out", "saved")

    def __init__(self, tag: str, node: int, name: str, main: bool, out: bool, saved: list[str] | None = None):
        self.tag, self.node, self.name, self.main, self.out, self.saved = tag, node, name, main, out, saved


class _Open:
    """The open elements, and at which depths those of each tag are."""

    def __init__(self, root: _Element):
        self.stack, self.depths = [root], {}

    def push(self, element: _Element) -> None:
        self.depths.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def pop(self) -> _Element:
        element = self.stack.pop()
        self.depths[element.tag].pop()
        return element

    def nearest(self, *tags: str) -> int:
        """Depth of the last open element of the tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def first_above(self, depth: int, tags: set[str]) -> int:
        """Depth of the first open element of the tags that lies deeper than ``depth``, 0 if there is none."""
        found = []
        for t in tags:
            at = self.depths.get(t, ())
            i = bisect_right(at, depth)
            found += at[i : i + 1]
        return min(found, default=0)


def _not_article(tag: str, attributes: dict[str, str], main: bool) -> bool:
    if tag in _OUT or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag == "header" and not main:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name in ("class", "id", "role"):
        for value in attributes.get(name, "").lower().split():
            words = set(_WORDS.findall(value))
            if not words & _AROUND and (words & _OUT_WORDS or (not main and words & _PAGE_HEADER)):
                return True
    return False


def tokens(page: str) -> Iterator[tuple[str | None, str, str, int]]:
    """(text, "", "", place after it) or (None, slash, name and attributes of a tag, place after it), in page order.

    A tag that does not close is text. Every character is looked at a fixed number of times. The place after a tag
    may be sent back to go on from another place.
    """
    at, end, quotes, last = 0, len(page), True, page.rfind(">")
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], "", "", end
            return
        if start > at:
            yield page[at:start], "", "", start
        at = start
        if found := _COMMENT.match(page, at):
            at = found.end()
            continue
        found = None
        if at < last and _TAG_START.match(page, at):
            found = _TAG.match(page, at) if quotes else _PLAIN.match(page, at)
            if found is None:
                quotes = False
                found = _PLAIN.match(page, at)
        if found is None:
            yield "<", "", "", at + 1
            at += 1
            continue
        at = (yield None, found[1], f"{found[2].lower()} {found[3]}", found.end()) or found.end()


def blocks_of(page: str) -> list[dict]:
    """Blocks in page order: node, name (its tag), text, main (inside an article or main element), out (declared
    not to be the article) and style (the child styles seen under the node).

    Time and memory are in proportion to the page, however deep its elements lie.
    """
    opened = _Open(_Element("", 0, "", False, False))
    stack = opened.stack
    children: dict[int, set[str]] = {}
    found: list[tuple[_Element, str]] = []
    pieces: list[str] = []

    def flush(owner: _Element) -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append((owner, text))

    def close(depth: int) -> None:
        nonlocal pieces
        while len(stack) > depth:
            top = opened.pop()
            if top.tag in _BLOCK:
                flush(top)
            elif top.saved is not None:
                flush(top)
                pieces = top.saved

    source, back = tokens(page), None
    last = page.rfind(">")
    while True:
        try:
            text, slash, rest, after = source.send(back)
        except StopIteration:
            break
        back = None
        if text is not None:
            pieces.append(text)
            continue
        tag, _, written_attributes = rest.partition(" ")
        if slash:
            if depth := opened.nearest(tag):
                close(depth)
            elif tag in _BLOCK:
                flush(stack[-1])
            continue
        if tag in _RAW:
            raw = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, after) if after < last else None
            back = raw.end() if raw else len(page)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in _BLOCK
        if tag == "body" and (depth := opened.nearest("head")):
            close(depth)
        if block:
            flush(stack[-1])
            if tag in _ENDS_P:
                depth = opened.nearest("p", "button", "td", "th")
                if depth and stack[depth].tag == "p":
                    close(depth)
            if tag in _ENDS:
                closes, until = _ENDS[tag]
                if lowest := opened.first_above(opened.nearest(*until), closes):
                    close(lowest)
        if tag in _VOID:
            continue
        above = stack[-1]
        attributes = {}
        if written_attributes.strip(" /\n\t\r"):
            for a in _ATTRIBUTE.finditer(written_attributes):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        out = above.out or _not_article(tag, attributes, above.main)
        if not block:
            if out == above.out:
                opened.push(_Element(tag, above.node, above.name, above.main, out))
            else:
                opened.push(_Element(tag, _signed(f"{above.node}>{tag}"), tag, above.main, out, pieces))
                pieces = []
            continue
        style = ".".join([tag, *sorted(set(attributes.get("class", "").split()))])
        children.setdefault(above.node, set()).add(style)
        main = above.main or tag in ("article", "main") or attributes.get("role", "").lower() == "main"
        opened.push(_Element(tag, _signed(f"{above.node}>{style}"), tag, main, out))
    close(1)
    flush(stack[0])
    styles = {node: _signed(">".join(sorted(below))) for node, below in children.items()}
    none = _signed("")
    return [
        {
            "node": e.node,
            "name": e.name,
            "text": t,
            "main": e.main,
            "out": e.out,
            "style": styles.get(e.node, none),
            "children": len(children.get(e.node, ())),
        }
        for e, t in found
    ]


def _kept_and_nodes(page: str) -> tuple[list[dict], int]:
    """Blocks for the tree, with ``fixed`` where entropy has no say, and a number for the page's content."""
    blocks = blocks_of(page)
    inside = [b for b in blocks if b["main"] and not b["out"]]
    if inside:
        for b in blocks:
            b["out"] = b["out"] or not b["main"]
    weight: dict[int, int] = {}
    for b in blocks:
        if not b["out"]:
            weight[b["node"]] = weight.get(b["node"], 0) + len(b["text"])
    heaviest = max(weight, key=weight.get, default=None)  # of equal ones the first
    for b in blocks:
        b["fixed"] = b["node"] == heaviest or b["name"] in ("h1", "h2", "h3", "h4", "h5", "h6")
    content = _signed("\n".join(f"{b['node']}\t{b['text']}" for b in blocks))
    return [
        {
            "node": b["node"],
            "style": b["style"],
            "children": b["children"],
            "text": b["text"],
            "keep": not b["out"],
            "fixed": b["fixed"],
        }
        for b in blocks
    ], content


_BLOCKS = "array<struct<node:bigint,style:bigint,children:int,text:string,keep:boolean,fixed:boolean>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content and blocks of every page, written."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            source = frame.pop("_html").tolist()
            for start in range(0, len(source), 64):
                part = frame.iloc[start : start + 64]
                read = [_kept_and_nodes(x) for x in source[start : start + 64]]
                yield part.assign(content=[c for _, c in read], blocks=[b for b, _ in read])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("_html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return written(
        map_texts(rows, batches, f"page_id {kind}, url string, host string, content long, blocks {_BLOCKS}"), "page-blocks"
    )


def style_tree(blocks: DataFrame) -> DataFrame:
    """host, node, pages, content_importance, presentation_importance, importance: one row per style node."""
    rows = blocks.select("host", "content", F.explode("blocks").alias("b")).select(
        "host", "content", "b.node", "b.style", "b.children", F.xxhash64("b.text").alias("feature")
    )
    rows = written(rows.distinct(), "page-features")
    shown = rows.groupBy("host", "node", "content").agg(F.min("style").alias("style"), F.max("children").alias("children"))
    pages = shown.groupBy("host", "node").agg(F.count("*").alias("pages"), F.max("children").alias("children"))
    features = rows.select("host", "node", "content", "feature").distinct().groupBy("host", "node", "feature")
    features = features.agg(F.count("*").alias("n")).groupBy("host", "node").agg(F.avg(F.log("n")).alias("spread"))
    styles = shown.groupBy("host", "node", "style").agg(F.count("*").alias("n"))
    # entropy of shares n / m is ln m - sum(n ln n) / m
    styles = styles.groupBy("host", "node").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("kept"))
    tree = pages.join(features, ["host", "node"]).join(styles, ["host", "node"])
    many = F.col("pages") > 1
    size = F.log("pages")
    child = F.pow(F.lit(GAMMA), "children")
    return (
        tree.withColumn("content_importance", F.when(many, 1 - F.col("spread") / size).otherwise(1.0))
        .withColumn("presentation_importance", F.when(many, 1 - F.col("kept") / size).otherwise(1.0))
        .withColumn("importance", (1 - child) * F.col("presentation_importance") + child * F.col("content_importance"))
        .select("host", "node", "pages", "content_importance", "presentation_importance", "importance")
    )


def with_noise(blocks: DataFrame, noisy: DataFrame) -> DataFrame:
    """Adds the unimportant nodes of each page's host. Texts move only where the hosts are too many to broadcast;
    then a host's list is copied to SALTS parts, as one host may have a third of all pages."""
    if noisy.count() <= BROADCAST_HOSTS:
        return blocks.join(F.broadcast(noisy), "host", "left")
    salted = noisy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.withColumn("_salt", F.pmod(F.xxhash64("page_id", "content"), F.lit(SALTS)).cast("int")).join(
        salted, ["host", "_salt"], "left"
    )


def main_text(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, and blocks_removed (how many blocks entropy took away)."""
    blocks = parsed(pages)
    noisy = style_tree(blocks).where((F.col("importance") < low) & (F.col("pages") >= min_pages))
    # a host has few style nodes: those of its templates
    noisy = written(noisy.groupBy("host").agg(F.collect_set("node").alias("_noisy")), "page-noise")
    rows = with_noise(blocks, noisy).withColumn("_noisy", F.coalesce("_noisy", F.array().cast("array<bigint>")))
    article = F.filter("blocks", lambda b: b["keep"])
    left = F.filter("_article", lambda b: b["fixed"] | ~F.array_contains("_noisy", b["node"]))
    text = F.array_join(F.transform("_left", lambda b: b["text"]), "\n")
    return (
        rows.withColumn("_article", article)
        .withColumn("_left", left)
        .select(
            "page_id",
            "url",
            text.alias("text"),
            F.length(text).cast("long").alias("n_chars"),
            (F.size("_article") - F.size("_left")).alias("blocks_removed"),
        )
    )
