"""Main text of web pages: boosted trees judge DOM nodes, and a decoding over the tree keeps the judgements consistent.

Each page is parsed to its block-level nodes. A node's features are its subtree's text, link and tag density, its
attribute tokens, depth and place among its siblings. The trees are trained here, on pages that ``training_pages``
makes from rules (many layouts, the node classes known); nothing is downloaded and no page of the input is used.
Decoding chooses for every node whether it is kept, with the best total log-probability under one condition: below a
dropped node nothing is kept. So an ancestor and a descendant can't contradict each other.

Scripts, styles, comments and markup never give text. Character references are decoded, white space inside a block
becomes one space, blocks stand in page order with an empty line between. Null and empty pages give an empty text.
Broken markup is closed where the page ends; a silent element other than a script or style ends with the block around
it. A self-closed silent element is empty unless its own closing tag comes next. Form controls and their labels give no
text. Pages of any length and depth are parsed whole, in linear time. Repeated rows are extracted alike; of two equally
good decodings the one that keeps less is taken. An empty table gives no rows; other columns pass through, one named
``text`` or ``n_chars`` is replaced.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.boosting import Boosted, fit_boosted
from memjobs.llm.common import extended, table

#: HTML elements by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg canvas iframe object audio video annotation annotation-xml head title textarea select datalist button label output meter progress".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input"
    " math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
#: Opening these ends an open paragraph.
BREAKS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Opening the first closes an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that stand between an element and an outer one that it would close.
SCOPE = frozenset("ul ol dl table td th div article section main body aside nav header footer form blockquote".split())
CLOSED = frozenset(("p", *(t for tags in CLOSES.values() for t in tags)))

#: Attribute tokens that speak for or against main text.
GOOD_TOKENS = frozenset("article content body entry post story text main page blog hentry prose markdown".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer foot header masthead top bottom comment comments reply replies discussion disqus respond share social cookie cookies consent notice notices alert modal popup overlay newsletter subscribe signup login form search related recommended more pagination pager tags meta byline copyright legal toolbar skip hidden rail".split()
)
COMMENT_TOKENS = frozenset("comment comments reply replies discussion disqus respond feedback".split())
NOTICE_TOKENS = frozenset("cookie cookies consent notice notices alert modal popup overlay newsletter subscribe banner".split())

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "tokens", "runs", "depth", "total", "links", "order", "words", "stops", "hidden", "n_blocks", "near")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str], hidden: bool):
        self.tag, self.parent, self.tokens, self.hidden = tag, parent, tokens, hidden
        self.children: list[Node] = []
        self.runs: list[tuple[int, str, bool]] = []  # place in the page, text, inside a link
        self.depth = parent.depth + 1 if parent else 0
        self.order = 0
        # of each tag that others close: the nearest such node at or above this one, unless a scope lies between
        above = parent.near if parent else {}
        if tag in SCOPE:
            above = {t: n for t, n in above.items() if t == tag}
        self.near: dict[str, Node] = {**above, tag: self} if tag in CLOSED else above


class _Tree(HTMLParser):
    """Block-level nodes of a page; inline elements only mark links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, frozenset(), False)
        self.silent: list[str] = []  # a silent element and what is open inside
        self.inside: Counter[str] = Counter()  # the same by tag
        self.start = 0
        self.links = self.place = 0
        self.nodes = [self.root]
        self.open: Counter[str] = Counter()  # tags of the nodes from the root down

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag not in VOID and tag not in INLINE:
                self._silence(tag)
            return
        if tag in SILENT:
            if tag == "head":
                return
            self._silence(tag)
            return
        if tag == "body":
            return
        if tag in INLINE:
            self.links += tag == "a"
            if tag in ("br", "img"):
                self.handle_data(" ")
            return
        if tag in BREAKS_P:
            self._close("p")
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.at.tag):
                self._leave(self.at)
        for closing in CLOSES.get(tag, ()):
            self._close(closing)
        if tag in VOID:
            return
        found, hidden = [tag] if tag in ("main", "article") else [], False
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop") and value:
                found += _TOKEN.findall(value.lower())
            elif name == "hidden" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                hidden = True
        self.at = Node(tag, self.at, frozenset(found), hidden)
        self.at.order = len(self.at.parent.children)
        self.at.parent.children.append(self.at)
        self.nodes.append(self.at)
        self.open[tag] += 1
        self.links = 0

    def _leave(self, node):
        """Close all nodes up to ``node``; each node is left once, so this is linear in all."""
        last = None
        while last is not node:
            last = self.at
            self.open[last.tag] -= 1
            self.at = last.parent

    def _close(self, tag):
        if node := self.at.near.get(tag):
            self._leave(node)

    def _silence(self, tag):
        self.silent.append(tag)
        self.inside[tag] += 1

    def _encloses(self, tag):
        return self.open[tag] > 0 or tag in ("html", "body", "head")

    def parse_starttag(self, i):
        self.start = i
        return super().parse_starttag(i)

    def handle_startendtag(self, tag, attrs):
        if self.silent:
            return
        if tag in SILENT:
            after = None if tag == "svg" else re.compile(rf"<(/?){tag}\b", re.I).search(self.rawdata, self.start + 1)
            if after and after[1]:
                self.handle_starttag(tag, attrs)
                if tag in self.CDATA_CONTENT_ELEMENTS and self.silent:
                    self.set_cdata_mode(tag)
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if self.inside[tag]:
                last = None
                while last != tag:
                    last = self.silent.pop()
                    self.inside[last] -= 1
                return
            if self.silent[0] in self.CDATA_CONTENT_ELEMENTS or not self._encloses(tag):
                return
            self.silent.clear()
            self.inside.clear()
        if tag in INLINE:
            self.links -= tag == "a" and self.links > 0
            return
        if tag in VOID or tag in ("html", "body", "head"):
            return
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._leave(node)
            self.links = 0

    def handle_data(self, data):
        if not self.silent:
            self.place += 1
            self.at.runs.append((self.place, data, self.links > 0))


def parse(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


#: Common short words of running text.
STOPS = frozenset("the of and to in a is that for it as was with be by on not he are this at from or la de que el en y un les des le et du une der die und das ist den von zu mit sich".split())
TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "h", "figure")
TAG_PLACE = {t: k for k, t in enumerate(TAGS)} | {f"h{n}": TAGS.index("h") for n in range(1, 7)}
N_FEATURES = 22 + 2 * len(TAGS)


def node_features(tree: _Tree) -> np.ndarray:
    """A row for each node in page order."""
    nodes = tree.nodes
    for node in nodes:
        own = [(text, link) for _, text, link in node.runs]
        node.total = sum(len(t.strip()) for t, _ in own)
        node.links = sum(len(t.strip()) for t, link in own if link)
        words = [w for t, _ in own for w in t.lower().split()]
        node.words, node.stops = len(words), sum(w in STOPS for w in words)
        node.n_blocks = 1
    for node in reversed(nodes[1:]):
        up = node.parent
        up.total += node.total
        up.links += node.links
        up.words += node.words
        up.stops += node.stops
        up.n_blocks += node.n_blocks
    whole = max(tree.root.total, 1)
    out = np.zeros((len(nodes), N_FEATURES))
    number = {id(n): k for k, n in enumerate(nodes)}
    # of each node and all above it: good and bad tokens, nodes with comment and notice tokens; tags
    marks, tags = [(0, 0, 0, 0)] * len(nodes), [frozenset()] * len(nodes)
    for k, node in enumerate(nodes):
        up = node.parent or node
        at = number[id(up)]
        good, bad = len(node.tokens & GOOD_TOKENS), len(node.tokens & BAD_TOKENS)
        comment, notice = not node.tokens.isdisjoint(COMMENT_TOKENS), not node.tokens.isdisjoint(NOTICE_TOKENS)
        above, tags_above = marks[at], tags[at]
        marks[k] = (above[0] + good, above[1] + bad, above[2] + comment, above[3] + notice)
        place = TAG_PLACE.get(node.tag)
        tags[k] = tags_above if place is None or place in tags_above else tags_above | {place}
        siblings = len(up.children)
        out[k, :22] = (
            np.log1p(node.total), node.links / max(node.total, 1), node.total / whole, node.total / max(node.n_blocks, 1),
            node.stops / max(node.words, 1), np.log1p(node.words), np.log1p(node.n_blocks), node.depth,
            good, bad, comment, notice, *above,
            node.order / max(siblings - 1, 1), siblings, node.total / max(up.total, 1), node.hidden,
            up.links / max(up.total, 1), np.log1p(up.total),
        )
        if place is not None:
            out[k, 22 + place] = 1
        for t in tags_above if k else ():
            out[k, 22 + len(TAGS) + t] = 1
    return out


def decode(tree: _Tree, p: np.ndarray) -> list[Node]:
    """The kept nodes: the best total log-probability such that nothing is kept below a dropped node."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    gain = np.log(p) - np.log1p(-p)  # of keeping rather than dropping
    at = {id(n): k for k, n in enumerate(tree.nodes)}
    best = gain.copy()
    for k in range(len(tree.nodes) - 1, 0, -1):
        up = at[id(tree.nodes[k].parent)]
        best[up] += max(best[k], 0.0)
    kept, out = np.zeros(len(tree.nodes), dtype=bool), []
    for k, node in enumerate(tree.nodes):
        kept[k] = k == 0 or (kept[at[id(node.parent)]] and best[k] > 0)
        if kept[k]:
            out.append(node)
    return out


def block_texts(kept: list[Node]) -> list[str]:
    """Texts of the kept nodes in page order; text around a child block is a block before and one after it."""
    runs = sorted((place, k, text) for k, node in enumerate(kept) for place, text, _ in node.runs)
    out: list[list[str]] = []
    last = -1
    for _, k, text in runs:
        if k != last:
            out.append([])
            last = k
        out[-1].append(text)
    blocks = (_SPACE.sub(" ", "".join(parts)).strip() for parts in out)
    return [b for b in blocks if b]


def extract_all(pages: list[str], model: Boosted, at_once: int = 256) -> list[str]:
    """The main text of each page. The nodes of ``at_once`` pages are judged together."""
    out = []
    for k in range(0, len(pages), at_once):
        trees = [parse(html) if html else None for html in pages[k : k + at_once]]
        rows = [node_features(t) for t in trees if t]
        p = model.probability(np.concatenate(rows)) if rows else np.empty(0)
        done = 0
        for tree in trees:
            if tree is None:
                out.append("")
                continue
            n = len(tree.nodes)
            out.append("\n\n".join(block_texts(decode(tree, p[done : done + n]))))
            done += n
    return out


# -- training pages, made from rules


def _sentence(rng: random.Random, n: int) -> str:
    letters = "etaoinshrdlucmfwypvbgkéüñ"
    words = [rng.choice(sorted(STOPS)) if rng.random() < 0.35 else "".join(rng.choices(letters, k=rng.randint(2, 11))) for _ in range(n)]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def training_pages(n: int = 500, seed: int = 11) -> list[tuple[str, set[int]]]:
    """Pages and the numbers of their main nodes (in page order; the root is 0)."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _page(rng: random.Random) -> tuple[str, set[int]]:
    parts: list[str] = []
    main: set[int] = set()
    count = [0]

    def attrs(*choices: str) -> str:
        value = rng.choice(choices)
        return f" {rng.choice(['class', 'class', 'id'])}={value!r}" if value else ""

    def element(tag: str, attr: str, inside, keep: bool, closed: bool = True) -> None:
        count[0] += 1
        if keep:
            main.add(count[0])
        parts.append(f"<{tag}{attr}>")
        inside()
        if closed:
            parts.append(f"</{tag}>")

    def text(low: int, high: int, keep_links: bool = False):
        def write() -> None:
            s = _sentence(rng, rng.randint(low, high))
            if rng.random() < 0.2:
                s = f"<b>{s}" if rng.random() < 0.5 else f"<em>{s}</em>"
            parts.append(f'<a href="/x">{s}</a>' if keep_links else s)
        return write

    def links(low: int, high: int):
        def write() -> None:
            for _ in range(rng.randint(low, high)):
                element("li", "", text(1, 3, True), False)
        return write

    def junk(place: str) -> None:
        kind = rng.choice({
            "top": ["nav", "nav", "header", "ad", "notice", "crumbs", "search"],
            "inside": ["ad", "share", "related", "newsletter", "aside"],
            "side": ["aside", "ad", "related", "menu"],
            "bottom": ["comments", "comments", "footer", "related", "form", "newsletter", "notice", "ad"],
        }[place])
        if kind == "nav":
            element("nav", attrs("", "navbar", "main-nav"), lambda: element("ul", attrs("", "menu"), links(3, 9), False), False)
        elif kind == "menu":
            element("div", attrs("menu", "nav", "navigation"), lambda: element("ul", "", links(3, 9), False), False)
        elif kind == "header":
            element("header", attrs("", "masthead", "site-header"), lambda: [element("h1", "", text(1, 4, True), False), element("p", "", text(3, 9), False)] if rng.random() < 0.5 else text(2, 8)(), False)
        elif kind == "ad":
            element("div", attrs("ad", "ads", "advert", "banner", "promo", "sponsored", "ad-slot"), text(3, 25) if rng.random() < 0.6 else lambda: element("p", "", text(3, 25), False), False)
        elif kind == "notice":
            element(rng.choice(["div", "section"]), attrs("cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup"), lambda: element("p", "", text(8, 40), False), False)
        elif kind == "crumbs":
            element("div", attrs("breadcrumb", "breadcrumbs"), text(2, 5, True), False)
        elif kind == "search":
            element("form", attrs("", "search"), text(1, 4), False)
        elif kind == "share":
            element("div", attrs("share", "social"), text(1, 5, True), False)
        elif kind == "related":
            element(rng.choice(["div", "section", "aside"]), attrs("related", "recommended", "more-stories"), lambda: [element("h3", "", text(1, 4), False), element("ul", "", links(2, 6), False)], False)
        elif kind in ("newsletter", "form"):
            element(rng.choice(["form", "div"]), attrs("newsletter", "subscribe", "signup"), lambda: [element("p", "", text(4, 20), False) for _ in range(rng.randint(1, 2))], False)
        elif kind == "aside":
            element(rng.choice(["aside", "div"]), attrs("sidebar", "side", "widget"), lambda: [element("p", "", text(4, 40), False) for _ in range(rng.randint(1, 4))], False)
        elif kind == "comments":
            element(rng.choice(["section", "div", "ol"]), attrs("comments", "comment-list", "discussion", "disqus", "replies"),
                    lambda: [element(rng.choice(["div", "article", "li"]), attrs("comment", "reply", ""), lambda: element("p", "", text(4, 60), False), False) for _ in range(rng.randint(1, 5))], False)
        else:
            element("footer", attrs("", "footer", "site-footer"), (lambda: [element("p", "", text(3, 20), False), element("ul", "", links(2, 6), False)]) if rng.random() < 0.4 else text(3, 20), False)

    def story() -> None:
        if rng.random() < 0.8:
            element(rng.choice(["h1", "h1", "h2"]), attrs("", "", "title"), text(1, 12), True)
        if rng.random() < 0.2:
            element("p", attrs("byline", "meta"), text(2, 5), True) if rng.random() < 0.3 else None
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            draw = rng.random()
            if draw < 0.7:
                element("p", "", text(1, 90), True, rng.random() < 0.9)
            elif draw < 0.78:
                element("blockquote", "", lambda: element("p", "", text(5, 40), True), True)
            elif draw < 0.86:
                element(rng.choice(["ul", "ol"]), "", lambda: [element("li", "", text(2, 25), True) for _ in range(rng.randint(1, 6))], True)
            elif draw < 0.92:
                element(rng.choice(["h2", "h3"]), "", text(1, 8), True)
            elif draw < 0.94:
                element("pre", "", text(5, 30), True)
            else:
                junk("inside")

    def body() -> None:
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            junk("top")
        holder = rng.choice(["article", "article", "article", "main", "div", "section"])
        name = attrs("", "", "post", "entry", "story") if holder != "div" else attrs("content", "post", "entry-content", "article-body", "main", "story")
        if rng.random() < 0.3:
            element(rng.choice(["main", "div"]), attrs("", "content", "page", "wrapper"), lambda: [element(holder, name, story, True), junk("side") if rng.random() < 0.6 else None, junk("bottom") if rng.random() < 0.4 else None], True)
        else:
            element(holder, name, story, True)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            junk(rng.choice(["side", "bottom", "bottom"]))
        if rng.random() < 0.7:
            element("footer", attrs("", "", "footer"), text(2, 25), False)

    count[0] = 0
    wrap = rng.random() < 0.95
    if wrap:
        count[0] += 1  # html
        main.add(1)
        parts.append("<html><head><title>x</title><style>p{}</style></head><body>")
    body()
    parts.append("</body></html>" if wrap and rng.random() < 0.9 else "")
    return "".join(parts), main | {0}


@cache
def trained(n_pages: int = 500, seed: int = 11) -> Boosted:
    """Trees fitted on ``n_pages`` made pages. The model is a few kilobytes and travels with the tasks."""
    x, y = [], []
    for html, main in training_pages(n_pages, seed):
        tree = parse(html)
        x.append(node_features(tree))
        y.append(np.array([k in main for k in range(len(tree.nodes))], dtype=float))
    return fit_boosted(np.concatenate(x), np.concatenate(y), trees=50, depth=4, rate=0.25)


def extract_text(pages: DataFrame, model: Boosted | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    model = model or trained()
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def compute(batch: pa.RecordBatch):
        texts = extract_all([html or "" for html in batch.column(html_col).to_pylist()], model)
        yield pa.array(texts, pa.string())
        yield pa.array([len(t) for t in texts], pa.int64())

    return extended(pages, compute, fields, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract_text(pages, keep=["page_id", "url"])
