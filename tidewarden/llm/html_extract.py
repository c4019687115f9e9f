"""Operator 10, main-text extraction from HTML by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). A logistic classifier over each
block's tags, class and id words, length and link density gives its cost as content and as
boilerplate: the terminal capacities. Edges between neighbours in the page, and between blocks whose
containers are close in the tree, charge for different labels. The minimum cut, found by augmenting
paths, separates content from boilerplate. Blocks whose own costs outweigh all their edges are
settled before; that changes no minimum cut.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
PLAIN = re.compile("[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-zA-Z]+")
#: Elements whose content is no text of the page. Fixed values of the HTML standard, as are the next three.
RAW = frozenset("script style noscript template textarea svg math iframe object title select canvas audio video noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li".split())
#: Elements and class words that tell boilerplate, and content.
BAD_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "header": 4.0, "menu": 6.0, "button": 6.0, "fieldset": 4.0, "dialog": 5.0, "address": 1.0, "figcaption": 0.5, "head": 9.0, "option": 6.0}
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs pager pagination toc skip header masthead topbar top footer foot bottom bottombar copyright legal disclaimer sidebar side rail aside widget widgets related recommended recommendations more trending popular "
    "comment comments commentlist respond reply replies discussion discussions disqus reactions feedback share sharing social follow subscribe subscription newsletter signup login signin register search form tag tags tagcloud meta byline rating author bio toolbar outbrain taboola hidden print complementary contentinfo".split()
)
STRONG_WORDS = frozenset("ad ads advert advertisement sponsored promo cookie cookies consent navbar navigation nav menu breadcrumb breadcrumbs footer sidebar comment comments commentlist disqus newsletter share social related widget replies reply pagination".split())
GOOD_TAGS = {"article": 3.0, "main": 2.0}
GOOD_WORDS = frozenset("article post entry content story main body text articlebody prose".split())
INFINITE = 10**9


@dataclass(slots=True)
class _Open:
    """An open element. ``box`` is the innermost that isn't inline: itself or one around it."""

    tag: str
    bad: float
    good: float
    link: bool
    node: int
    parent: _Open | None
    #: how many elements that aren't inline are open, this one included
    depth: int
    box: _Open | None = None


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    bad: float
    good: float
    tag: str
    box: _Open


class _Stack:
    """The open elements, with the places of each tag, so that no step walks over the whole stack."""

    def __init__(self) -> None:
        self.items: list[_Open] = []
        self.at: dict[str, list[int]] = {}

    def push(self, x: _Open) -> None:
        self.at.setdefault(x.tag, []).append(len(self.items))
        self.items.append(x)

    def last(self, *tags: str) -> int:
        """Place of the innermost of these tags; 0 (the page itself) if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, to: int) -> None:
        while len(self.items) > to:
            self.at[self.items.pop().tag].pop()


class _Tags:
    """Where tags end. Quotes are heeded until one of them never closes; each search goes on from the last."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none in the page."""
        page = self.page
        if self.quotes:
            place = at
            while True:
                place = PLAIN.match(page, place).end()
                if place == len(page):
                    break
                if page[place] == ">":
                    return place
                close = page.find(page[place], place + 1)
                if close < 0:
                    break
                place = close + 1
            self.quotes = False
        return page.find(">", at)


#: Items that an element of the same list ends, and the lists at which that stops. Fixed values of the HTML standard.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def blocks_of(page: str) -> list[Block]:
    """Time grows with the page's length, however deep or broken its markup."""
    out: list[Block] = []
    root = _Open("", 0.0, 0.0, False, 0, None, 1)
    root.box = root
    stack, tags = _Stack(), _Tags(page)
    stack.push(root)
    text: list[str] = []
    linked = count = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                top = stack.items[-1]
                out.append(Block(" ".join(words), len(words), linked, top.bad, top.good, top.box.tag, top.box))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html_lib.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if stack.items[-1].link:
                linked += len(piece.split())

    end, search = len(page), START.search
    while at < end:
        m = search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        tag = m[2]
        if not tag:
            if m[0] == "<!--":
                close = page.find("-->", m.end())
                at = close + 3 if close >= 0 else end
                continue
            close = page.find(">", m.end())
            if close < 0:
                add(page[m.start() :])
                break
            at = close + 1
            continue
        close = tags.end(m.end())
        if close < 0:
            add(page[m.start() :])
            break
        tag, closing, rest, at = tag.lower(), bool(m[1]), page[m.end() : close], close + 1
        if closing:
            i = stack.last(tag)
            if not i:
                if tag in ("br", "p"):
                    flush()
            elif tag not in INLINE:
                flush()
                stack.cut(i)
            elif stack.items[i].depth == stack.items[-1].depth:  # an inline end tag doesn't close the blocks opened since
                stack.cut(i)
            continue
        if tag in RAW:
            if tag not in ("svg", "math") or not rest.endswith("/"):
                found = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                close = page.find(">", found.end()) if found else -1
                at = close + 1 if close >= 0 else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in ENDS:
            # implied end tags: an open p, or an open item of the same list
            p = stack.last("p") if tag in CLOSES_P else 0
            if own := ENDS.get(tag):
                stop = stack.last(*STOPS.get(tag, ()))
                if (i := stack.last(*own)) > stop:
                    stack.cut(i)
                elif p > stop:
                    stack.cut(next(x for x in stack.at["p"] if x > stop))
            elif p and stack.items[p].depth == stack.items[-1].depth:
                stack.cut(p)
        top = stack.items[-1]
        bad, good = top.bad + BAD_TAGS.get(tag, 0.0), top.good + GOOD_TAGS.get(tag, 0.0)
        if tag == "header" and top.good >= 3:
            bad = top.bad  # an article's own header holds its title
        if tag not in ("body", "html") and rest and ("=" in rest or "hidden" in rest):
            for a in ATTRIBUTE.finditer(rest):
                name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if name in ("hidden", "aria-hidden", "style"):
                    if name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
                        bad += 9.0
                    continue
                names = NAME.findall(value)
                if any(x in STRONG_WORDS for x in names):
                    bad += 6.0
                elif any(x in BAD_WORDS for x in names):
                    bad += 3.5 if tag not in INLINE else 1.0
                elif any(x in GOOD_WORDS for x in names):
                    good += 1.0
        count += 1
        inline = tag in INLINE
        x = _Open(tag, bad, min(good, 4.0), top.link or tag == "a", count, None if inline else top.box, top.depth + (not inline))
        x.box = top.box if inline else x
        stack.push(x)
    flush()
    return out


def logit(b: Block, has_article: bool) -> float:
    """Log-odds that a block is content."""
    z = -0.6 + 1.3 * b.good - b.bad + 0.9 * math.log1p(b.words) - 4.0 * b.linked / b.words
    if has_article and b.good < 2:
        z -= 3.0
    if b.tag in ("h1", "h2", "h3", "h4", "p", "blockquote", "pre"):
        z += 1.0
    elif b.tag == "li":
        z -= 0.5
    return max(-12.0, min(12.0, z))


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """cost[i] > 0: what labelling i boilerplate costs; < 0: content. Returns who is content."""
    n = len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    cost = list(cost)
    # settle blocks whose own cost outweighs their edges, and hand their pull to their neighbours
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                cost[j] += w if label[i] else -w
                del near[j][i]
                if label[j] is None:
                    todo.append(j)
            near[i] = {}
    # what is left falls into parts that no edge joins
    seen = [x is not None for x in label]
    for start in range(n):
        if seen[start]:
            continue
        part, seen[start] = [start], True
        for i in part:
            for j in near[i]:
                if not seen[j]:
                    seen[j] = True
                    part.append(j)
        for i, x in zip(part, _max_flow(part, cost, near), strict=True):
            label[i] = x
    return [bool(x) for x in label]


def _max_flow(part: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which of part lie on the source's side of the minimum cut; shortest augmenting paths, a level graph at a time."""
    place = {i: k for k, i in enumerate(part)}
    source, sink = len(part), len(part) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(part) + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        for x, y, w in ((a, b, there), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(w)

    for i in part:
        if cost[i] > 0:
            edge(source, place[i], cost[i], 0.0)
        elif cost[i] < 0:
            edge(place[i], sink, -cost[i], 0.0)
        for j, w in near[i].items():
            if j > i:
                edge(place[i], place[j], w, w)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [k in level for k in range(len(part))]
        turn = [0] * len(out)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                # back to the first edge that is full
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > 1e-9 and level.get(to[e]) == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def _steps(a: _Open, b: _Open) -> int:
    """Elements between two boxes by way of the innermost one around both."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def extract(page: str) -> str:
    """The page's main text: its content blocks, one a line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    has_article = any(b.good >= 2 and b.bad < 3 for b in blocks)
    cost = [logit(b, has_article) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:  # neighbours' ways sum up to one walk through the tree
            edges.append((i - 1, i, 0.8 / (1 + _steps(blocks[i - 1].box, b.box))))
        parent = b.box.parent.node if b.box.parent else -1
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, 0.4))
        last[parent] = i
    return "\n".join(b.text for b, content in zip(blocks, minimum_cut(cost, edges), strict=True) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null or empty html gives an empty text, as does a page without content. White space inside a
    block (any Unicode white space, and <br>) becomes one space. Rows that repeat come out repeated;
    only page_id, url and html are read.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
