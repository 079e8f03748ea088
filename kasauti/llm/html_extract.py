r"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree: elements with the same path
of tags, classes and ids (digits left out) are one node. A node's *content*
importance is the entropy of the texts of its blocks, relative to that of as many
different ones; its *presentation* importance that of the sequences of children it
shows, relative to ``LAYOUTS`` equally frequent ones, so that neither shrinks as
pages are added. A host's few texts say little, so each node is drawn towards the
same node of all hosts, and this towards ``NEUTRAL``, by ``PRIOR`` observations; a
text that repeats counts as one observation, so copies of a page don't make it
noise. A block's branch has the importance of the tree

    CONTENT * content(block) + (1 - CONTENT) * presentation(its parent)

relative to that of the page's most important one, and what the page says is
evidence beside it: (1 - weight) * tree + weight * mark. Branches of an importance
below ``THRESHOLD`` go. The evidence, by block:

* *left out* (never stays): within elements whose tag or role names a menu, header,
  footer, sidebar, notice, form and so on, or whose class or id is made of words for
  these, adverts or comments and of neutral words alone. The page's article is the
  outermost one with most text, outside boxes that are named so if there is such (or a main);
  only what is around it is a wrapper, whose class, form or header says nothing, so
  comments and teasers that are articles themselves go with their box.
* *named for what repeats*: in the region, in a box named menu, notice and so on by class
  or id alone. It stays where the host's tree is sure that its texts differ.
* *region*: in ``article`` or ``main``. Without such a mark the tree decides alone;
  with one, what is outside goes, and what is in ``main`` beside an ``article`` needs
  a tree that speaks for it. Articles that call themselves cards or teasers are no
  region, and with more text beside them than in them ``main`` is the region.
* *doubtful*: a word for boilerplate among other words. Within a region the two
  marks cancel out and the tree decides; elsewhere the tree must be sure.

Statistics are counted for each task's batch, then aggregated by host, node and
hash with map-side combining. Pages then meet their host's nodes, which a task
reads once for all pages of the host. Of hosts with more pages than one in
``HOT_HOSTS`` of all, pages are dealt out by hash and the nodes repeated, never
more often than there are pages; there are at most ``HOT_HOSTS`` such hosts.

How many blocks went, and how many the tree alone would drop, is told for each page.

A block is the text between two boundaries of block elements, with character
references decoded and runs of white space as one space; ``<br>`` is white space.
Unclosed and stray tags are handled as browsers do in the common cases (an open
``p`` ends where a block starts, ``li`` at the next ``li``, ...). Parsing takes time
in proportion to the page: below ``DEPTH`` elements belong to the one above, as in
browsers, and where a quote in a tag is never closed, quotes count no more in the
rest of the page.

Defined cases: null or empty html gives the empty text; a page without host
belongs to the host ""; an unclosed comment, script or style and a tag that never
ends swallow the rest; empty tables give empty results; repeated rows each give a
row; further columns are ignored. A node that only one page shows is neutral, so a
table of one page is judged by its marks.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .url_filters import host_of

CONTENT = 0.6
LAYOUTS = 8
PRIOR = 20
NEUTRAL = 0.5
THRESHOLD = 0.75
#: Importance of content that surely differs from page to page.
SURE = 0.9
DEPTH = 512
#: Evidence of mark and weight: in the page's region; there, but doubtful; in main beside an article; doubtful on a page without region.
REGION, REGION_DOUBTFUL, BESIDE, DOUBTFUL_ALONE, NONE = (1.0, 0.6), (THRESHOLD, 0.4), (0.65, 0.4), (0.0, 0.2), (0.0, 0.0)
#: Hosts whose pages are dealt out, and the fewest pages worth it.
HOT_HOSTS, HOT_PAGES = 10_000, 256

# Names of HTML elements and of what is not an article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meta link q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT_TAGS = frozenset("nav footer aside head button select dialog menu object".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
LEFT_OUT_WORDS = ADVERT_WORDS | frozenset(
    "banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination pager popup recommended related respond share sharing sidebar signup social subscribe toolbar widget widgets".split()
)
#: Those that name what is the same on a host's pages, so that its tree can tell when they name something else.
SAME_WORDS = frozenset("banner cookie cookies consent footer gdpr header login masthead menu menubar nav navbar navigation newsletter notice notices signup subscribe toolbar".split())
CARD_WORDS = frozenset("card cards teaser teasers preview previews".split())
NEUTRAL_WORDS = frozenset(
    "main site page global top bottom left right upper lower inner outer primary secondary mobile desktop sticky fixed container wrapper wrap holder box block area region section row col column list item items group slot bar unit zone module component panel strip link links text title body form inline large small medium js sm md lg xs xl".split()
)
NOT_A_MARK = frozenset("has have no not non with without hide hidden show".split())
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset()),
}

#: A comment or declaration starts, or a whole tag: /, name, attributes, and > unless it never ends.
#: A quote counts where a value begins, nowhere else.
TAG = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>|$)))*+)(>?)")
#: The same where quotes don't count.
TAG_UNQUOTED = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(>?)")
#: Name and value of each attribute.
NAMED = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
MARKS = frozenset(["class", "id", "role"])
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE) for tag in RAW}

# What an element says of itself.
NOTHING, SEALED, UNLESS_WRAPPER, FORM, NAMED_SAME, HEADER, DOUBTFUL, MAIN, ARTICLE, CARD = range(10)
# Where a block lies.
OUT, OUTSIDE, IN_MAIN, IN_ARTICLE = range(4)


class Element:
    __slots__ = ("tag", "key", "parent", "says", "sealed", "boxed", "article", "holds", "children", "told")

    def __init__(self, tag: str, key: int, parent: Element | None, says: int):
        self.tag, self.key, self.parent, self.says = tag, key, parent, says
        #: Within a menu, footer, sidebar and so on, where no article is the page's.
        self.sealed: bool = says == SEALED or parent is not None and parent.sealed
        #: Within a box that only its class or id calls so.
        self.boxed: bool = says in (UNLESS_WRAPPER, NAMED_SAME) or parent is not None and parent.boxed
        #: The outermost article or, without one, the outermost main around it.
        above = parent.article if parent is not None else None
        self.article: Element | None = self if says == ARTICLE and (above is None or above.says == MAIN) or says == MAIN and above is None else above
        #: Whether the page's article or main is below.
        self.holds = False
        self.children: list[int] = []
        self.told: tuple[int, bool, bool] | None = None

    def place(self) -> tuple[int, bool, bool]:
        """Where its text lies, whether that is doubtful, and whether it is in a box that is named for what all pages repeat; asked once the page is read."""
        if self.told is None:
            chain, e = [], self
            while e is not None and e.told is None:
                chain.append(e)
                e = e.parent
            region, doubtful, same = e.told if e is not None else (OUTSIDE, False, False)
            for e in reversed(chain):
                if region != OUT:
                    if e.says == NAMED_SAME and not e.holds and region in (IN_ARTICLE, IN_MAIN):
                        same = True
                    elif e.says == SEALED or e.says in (UNLESS_WRAPPER, FORM, NAMED_SAME) and not e.holds or e.says == HEADER and region == OUTSIDE and not e.holds:
                        region = OUT
                    elif e.says == ARTICLE:
                        region, doubtful = IN_ARTICLE, False
                    elif e.says == MAIN and region == OUTSIDE:
                        region, doubtful = IN_MAIN, False
                    elif e.says == DOUBTFUL and not e.holds:
                        doubtful = True
                e.told = region, doubtful, same
        return self.told


def _choose(blocks: list[Block]) -> None:
    """The page's article, and its main, are those with most text, outside boxes if there are such; what is around them is a wrapper."""
    size: Counter[Element] = Counter()
    for b in blocks:
        e = b.element.article
        if e is not None and not e.sealed:
            size[e] += len(b.text)
    free = lambda e: e.parent is None or not e.parent.boxed
    any_free_main = any(e.says == MAIN and free(e) for e in size)
    for kind in (ARTICLE, MAIN):
        e = max((e for e in size if e.says == kind), key=lambda e: (free(e), size[e]), default=None)
        if e is None or kind == ARTICLE and any_free_main and not free(e):
            continue
        e = e.parent
        while e is not None and not e.holds:
            e.holds, e = True, e.parent


class Block(NamedTuple):
    element: Element
    text: str


def _key(parent: int, mark: str) -> int:
    return xxhash.xxh64_intdigest(mark, parent & (2**64 - 1)) - 2**63


def _token_says(words: set[str]) -> int:
    """What one class or id says by its words."""
    if not words & LEFT_OUT_WORDS or words & NOT_A_MARK:
        return NOTHING
    if words - LEFT_OUT_WORDS - NEUTRAL_WORDS:
        return DOUBTFUL
    listed = words & LEFT_OUT_WORDS
    return HEADER if listed == {"header"} else NAMED_SAME if listed <= SAME_WORDS else UNLESS_WRAPPER


def _reads(tag: str, attributes: str) -> tuple[int, str]:
    """What an element says, and what marks it among its siblings."""
    mark, role, tokens = tag, "", []
    if "=" in attributes:
        for name, *values in NAMED.findall(attributes):
            value, name = "".join(values), name.lower()
            if name not in MARKS:
                continue
            if name == "role":
                role = value.lower()
            elif value:
                mark += f" {name}={DIGITS.sub('', value)}"
                if tag in HEADINGS and name == "id":
                    continue  # an anchor
                tokens += [{w.lower() for w in PARTS.findall(token)} for token in value.split()]
    if tag in LEFT_OUT_TAGS or role in LEFT_OUT_ROLES:
        return SEALED, mark
    region = ARTICLE if tag == "article" or role == "article" else MAIN if tag == "main" or role == "main" else NOTHING
    if region:
        # Topics and states of an article stand in its classes too: only words of their own count.
        if any(words <= LEFT_OUT_WORDS | NEUTRAL_WORDS and words & LEFT_OUT_WORDS - {"header", "share", "social"} for words in tokens):
            return SEALED, mark
        return CARD if region == ARTICLE and any(words & CARD_WORDS for words in tokens) else region, mark
    if tag in ("html", "body"):
        return NOTHING, mark
    says = {_token_says(words) for words in tokens}
    if UNLESS_WRAPPER in says:
        return UNLESS_WRAPPER, mark
    if tag == "form":
        return FORM, mark
    if NAMED_SAME in says:
        return NAMED_SAME, mark
    if tag == "header" or HEADER in says:
        return HEADER, mark
    return DOUBTFUL if DOUBTFUL in says else NOTHING, mark


def _is_advert(attributes: str) -> bool:
    """Of an inline element, whose other words are no region's."""
    words = ({w.lower() for w in PARTS.findall(token)} for name, *values in NAMED.findall(attributes) if name.lower() in ("class", "id") for token in "".join(values).split())
    return any(w & ADVERT_WORDS and w <= ADVERT_WORDS | NEUTRAL_WORDS for w in words)


def parse(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks in page order, and (node, hash of its children) of every element with children."""
    root = Element("", 0, None, NOTHING)
    stack, blocks, shown = [root], [], []
    #: Where in the stack each tag stands.
    open_at: defaultdict[str, list[int]] = defaultdict(list)
    text: list[str] = []
    deeper = 0
    #: The advert in a line that is open, how many of its name are, and the blocks' element before it.
    advert, nested = "", 0
    apart: Element | None = None

    def flush() -> None:
        words = entities.unescape("".join(text)).split()
        text.clear()
        if words:
            blocks.append(Block(apart or stack[-1], " ".join(words)))

    def pop(n: int) -> None:
        while len(stack) > n:
            e = stack.pop()
            open_at[e.tag].pop()
            if e.children:
                shown.append((e.key, xxhash.xxh64_intdigest(repr(e.children)) - 2**63))

    at, end, pattern = 0, len(page), TAG
    while at < end:
        found = pattern.search(page, at)
        if not found:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
        closing, tag, attributes, whole = found.groups()
        at = found.end()
        if tag is None:
            stop = page.find("-->", at) + 3 if found[0] == "<!--" else page.find(">", at) + 1
            at = stop if stop > at else end
            continue
        if not whole:
            if pattern is TAG_UNQUOTED:
                break
            at, pattern = found.start(), TAG_UNQUOTED
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            if closing and tag == advert:
                nested -= 1
                if not nested:
                    flush()
                    advert, apart = "", None
            elif not closing and tag == advert:
                nested += 1
            elif not closing and not advert and "=" in attributes and tag not in VOID and _is_advert(attributes):
                flush()
                advert, nested, apart = tag, 1, Element(tag, _key(stack[-1].key, tag), stack[-1], SEALED)
            continue
        if text:
            flush()
        advert, apart = "", None
        if closing:
            if deeper:
                deeper -= 1
            elif open_at[tag]:
                pop(open_at[tag][-1])
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = CLOSING[tag].search(page, at)
                at = close.end() if close else end
            continue
        if stack[-1].tag == "p" and not deeper:
            pop(len(stack) - 1)
        if tag in CLOSES and not deeper:
            same, bounds = CLOSES[tag]
            nearest = max((open_at[t][-1] for t in same if open_at[t]), default=0)
            if nearest > max((open_at[t][-1] for t in bounds if open_at[t]), default=0):
                pop(nearest)
        if tag in VOID:
            continue
        if len(stack) > DEPTH:
            deeper += 1
            continue
        above = stack[-1]
        says, mark = _reads(tag, attributes)
        key = _key(above.key, mark)
        above.children.append(key)
        element = Element(tag, key, above, says)
        open_at[tag].append(len(stack))
        stack.append(element)
    if text:
        flush()
    pop(1)
    _choose(blocks)
    return blocks, shown


def _statistics(pages: DataFrame) -> DataFrame:
    """host, node, kind (content, presentation), hash and n of the merged trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple] = Counter()
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blocks, shown = parse(page)
                seen.update((host, x.element.key, "content", xxhash.xxh64_intdigest(x.text.encode("utf-8", "surrogatepass")) - 2**63) for x in blocks)
                seen.update((host, node, "presentation", children) for node, children in shown)
            rows = [(*k, n) for k, n in seen.items()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["host", "node", "kind", "hash", "n"])

    counted = pages.select("host", "html").mapInArrow(run, "host string, node long, kind string, hash long, n long")
    return counted.groupBy("host", "node", "kind", "hash").agg(F.sum("n").alias("n"))


def _drawn(own: Column, usual: Column | float) -> Column:
    """Towards ``usual``, by PRIOR against as many observations as there are different ones."""
    return (F.col("different") * own + PRIOR * F.lit(usual)) / (F.col("different") + PRIOR)


def importances(pages: DataFrame) -> DataFrame:
    """host, node and importance: of its content, and as ~node of its presentation. Nodes that are neutral are left out."""
    counted = cut(_statistics(pages))
    entropy = [F.sum("n").alias("seen"), F.count(F.lit(1)).alias("different"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("bits")]
    most = F.when(F.col("kind") == "content", F.log("seen")).otherwise(F.least(F.log("seen"), F.lit(math.log(LAYOUTS))))
    relative = F.when(F.col("seen") > 1, F.least(F.lit(1.0), F.col("bits") / most))
    everywhere = counted.groupBy("node", "kind", "hash").agg(F.sum("n").alias("n")).groupBy("node", "kind").agg(*entropy)
    everywhere = everywhere.filter("seen > 1").select("node", "kind", _drawn(relative, NEUTRAL).alias("usual"))
    here = counted.groupBy("host", "node", "kind").agg(*entropy).withColumn("own", relative)
    drawn = here.join(everywhere, ["node", "kind"]).withColumn("importance", _drawn(F.coalesce("own", "usual"), F.col("usual")))
    key = F.when(F.col("kind") == "content", F.col("node")).otherwise(F.bitwise_not("node"))
    return drawn.select("host", key.alias("node"), "importance")


def branch(element: Element, nodes: dict[int, float]) -> float:
    """Importance of a block's branch by the tree alone."""
    above = element.parent.key if element.parent else 0
    return CONTENT * nodes.get(element.key, NEUTRAL) + (1 - CONTENT) * nodes.get(~above, NEUTRAL)


COUNTS = ["n_blocks", "n_tree", "n_gone", "n_both"]


class Judged(NamedTuple):
    """The main text of a page, its blocks, those that the tree alone would drop, those that went, and of these the ones that the tree alone would drop too."""

    text: str
    blocks: int
    tree: int
    gone: int
    both: int


def judged(page: str, nodes: dict[int, float], marks: bool = True) -> Judged:
    """Every block by the tree's importance of its branch, with the page's marks as evidence beside it (unless ``marks`` are not to be read)."""
    blocks, _ = parse(page)
    tree = [branch(b.element, nodes) for b in blocks]
    evidence: list[tuple[float, float] | None] = [NONE] * len(blocks)
    if marks:
        places = [b.element.place() for b in blocks]
        size = [0, 0, 0, 0]
        for b, (region, _, same) in zip(blocks, places):
            size[region] += len(b.text) * (not same)
        wanted = next((r for r in (IN_ARTICLE, IN_MAIN) if size[r]), OUTSIDE)
        if size[IN_MAIN] > size[IN_ARTICLE]:
            wanted = IN_MAIN
        for k, (b, (region, doubtful, same)) in enumerate(zip(blocks, places)):
            if region == OUT or region == OUTSIDE != wanted:
                evidence[k] = None
            elif same:
                # Named for what all pages repeat: stays only if the tree is sure that it is not.
                evidence[k] = REGION if nodes.get(b.element.key, NEUTRAL) >= SURE else None
            elif wanted == OUTSIDE:
                evidence[k] = DOUBTFUL_ALONE if doubtful else NONE
            elif region < wanted:
                evidence[k] = BESIDE
            else:
                evidence[k] = REGION_DOUBTFUL if doubtful else REGION
    best = max((t for t, e in zip(tree, evidence) if e is not None), default=1.0)
    stays = [e is not None and (1 - e[1]) * t / best + e[1] * e[0] >= THRESHOLD for t, e in zip(tree, evidence)]
    most = max(tree, default=1.0)
    alone = [t / most >= THRESHOLD for t in tree]
    text = "\n".join(b.text for b, k in zip(blocks, stays) if k)
    return Judged(text, len(blocks), alone.count(False), stays.count(False), sum(not a and not k for a, k in zip(alone, stays)))


def main_text(page: str, nodes: dict[int, float], marks: bool = True) -> str:
    """The blocks that stay; without ``marks`` by the tree alone."""
    return judged(page, nodes, marks).text


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", marks: bool = True) -> DataFrame:
    """id_col, url_col, text, n_chars of every page, and its blocks: n_blocks, n_tree (the tree alone would drop them), n_gone, n_both (gone and dropped by the tree alone too)."""
    pages = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host_of(f"`{url_col}`").alias("host"), text_or_empty(f"`{html_col}`").alias("html"))
    nodes = cut(importances(pages))
    counts = cut(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    total = counts.agg(F.sum("pages")).first()[0] or 0
    many = max(HOT_PAGES, total // HOT_HOSTS + 1)
    # At most HOT_HOSTS rows: each host has more than its share of all pages.
    hot = F.broadcast(counts.filter(F.col("pages") >= many))
    # A hot host without nodes (no html at all) is dealt out by its pages alone.
    own = counts.filter(F.col("pages") >= many).join(nodes.join(hot.select("host"), "host").groupBy("host").agg(F.count(F.lit(1)).alias("nodes")), "host", "left")
    dealt = F.broadcast(cut(own.select("host", F.ceil(F.col("pages") / F.greatest(F.lit(many), F.coalesce("nodes", F.lit(0)))).cast("int").alias("parts"))))
    parts = F.coalesce("parts", F.lit(1))

    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema if f.name != "host"}
    first = nodes.join(dealt, "host", "left").select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "node", "importance", *empty.values())
    then = pages.join(dealt, "host", "left").select("host", F.pmod(F.xxhash64("id", "url", "html"), parts).cast("int").alias("part"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("importance"), *empty)
    # Null nodes last: behind all nodes of the host come its pages.
    met = first.unionByName(then).repartition("host", "part").sortWithinPartitions("host", "part", F.col("node").asc_nulls_last())
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, {}
        for b in batches:
            hosts, at, value, htmls = (b.column(c).to_pylist() for c in ("host", "node", "importance", "html"))
            rows, texts = [], []
            for i, (host, node) in enumerate(zip(hosts, at)):
                if host != last:
                    last, own = host, {}
                if node is not None:
                    own[node] = value[i]
                else:
                    rows.append(i)
                    texts.append(judged(htmls[i], own, marks))
            some = b.take(pa.array(rows, pa.int64()))
            counts = [pa.array([x[k] for x in texts], pa.int64()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("url"), pa.array([x.text for x in texts], pa.string()), pa.array([len(x.text) for x in texts], pa.int64()), *counts], names=["id", "url", "text", "n_chars", *COUNTS])

    done = met.mapInArrow(run, f"id {kind}, url string, text string, n_chars long, {', '.join(f'{c} long' for c in COUNTS)}")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", *COUNTS)
