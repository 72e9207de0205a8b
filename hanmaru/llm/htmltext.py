"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree. Every node gets features: its kind, tokens of its attributes and of its ancestors', depth,
text and link density of its subtree, sibling statistics and place. Boosted trees give each node the log odds of belonging
to the article. Decoding then picks for the whole tree the assignment of greatest total score in which no node of the
article stands below a boilerplate node: a node is part of the article (below it boilerplate may be cut out), boilerplate
(and all below it), or a container of both. Text in page order, one block per block-level element, is what the article
nodes hold.

There are no labelled pages, so the trees are trained on pages that `synthetic_page` makes up with known answers: layouts,
class names and faults such as unclosed elements vary at random from a fixed seed. The model is of fixed size.

Fixed cases: null and empty html give empty text; text outside of any element counts as the body's; html without an
article-like node gives what decoding finds, maybe nothing; unclosed and wrongly nested elements are closed the way
browsers do for paragraphs, list items and table cells; object, canvas, audio and video lose their content at their end tag,
none if it never comes; svg and math end at theirs, at their own slash, or before an element of HTML; repeated pages give equal rows; a null page_id or url is kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values of the HTML standard -------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag and is no text of the page.
RAW = frozenset("script style textarea title noscript template iframe".split())
#: Foreign elements, skipped whole, nested ones included; they may close themselves.
FOREIGN = frozenset("svg math".split())
#: Parsed as any other element, but emptied when their end tag comes; those left open cost no text.
MUTE = frozenset("object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening element of the key closes an open one of these kinds, up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = BLOCK - frozenset("body html head li dd dt td th tr tbody thead tfoot option optgroup legend summary".split())
# --- words of attributes ---------------------------------------------------------------------------------------------
BAD = frozenset(
    "ad ads adv advert advertisement adslot banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail "
    "footer foot header masthead topbar toolbar comment comments disqus reply replies respond cookie cookies consent notice notification alert "
    "popup modal overlay share sharing social follow related recommended more newsletter subscribe signup login search form widget tags meta "
    "pagination pager skip copyright legal gdpr disclaimer".split()
)
GOOD = frozenset("article articlebody content post entry story text body main maincontent page prose hentry blog news paragraph".split())

#: A start or end tag by the standard's states; possessive, so it never goes back. A slash that ends an unquoted value is part of it.
ATTRS = r"""(?:\s++|/(?!>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+"""
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)({ATTRS})(/?)>")
ATTR = re.compile(r"""(?:class|id|role|itemprop|name)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""display\s*:\s*none|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
KINDS = ("article", "main", "nav", "header", "footer", "aside", "section", "div", "p", "h", "li", "list", "a", "table", "form", "quote", "inline", "root")
KIND_OF = {k: k for k in ("article", "main", "nav", "header", "footer", "aside", "section", "div", "p", "li", "a")} | {
    **dict.fromkeys(HEADINGS, "h"), **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("dt", "dd"), "li"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th"), "table"),
    **dict.fromkeys(("form", "button", "select", "option", "label", "fieldset", "legend", "dialog", "search"), "form"),
    **dict.fromkeys(("blockquote", "pre", "figure", "figcaption"), "quote"), **dict.fromkeys(("html", "body", "#root"), "root"),
}


class Node:
    """An element: tag, attribute text, and items, which are texts and elements in page order."""

    __slots__ = ("attrs", "items", "label", "tag")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.items, self.label = tag, attrs, [], 0


class Open:
    """The open elements, with counts that tell without a look at all of them whether one of a kind is open."""

    def __init__(self, root: Node) -> None:
        self.stack, self.counts, self.ps = [root], Counter(), [0]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.counts[node.tag] += 1
        if node.tag in EDGES_P:
            self.ps.append(0)
        elif node.tag == "p":
            self.ps[-1] += 1

    def pop_to(self, i: int) -> None:
        """Closes the element at place i and all within it."""
        while len(self.stack) > i:
            tag = self.stack.pop().tag
            self.counts[tag] -= 1
            if tag in EDGES_P:
                self.ps.pop()
            elif tag == "p":
                self.ps[-1] -= 1

    def last(self, kinds: frozenset[str] | set[str], edge: frozenset[str] | set[str] = frozenset()) -> int:
        """Place of the innermost open element of the kinds; 0 if an edge comes before it or there is none."""
        if any(self.counts[k] for k in kinds):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in kinds:
                    return i
                if self.stack[i].tag in edge:
                    return 0
        return 0

    def close(self, tag: str) -> None:
        """Closes the innermost open element of that tag, but an inline end never closes a block."""
        i = self.last({tag}, BLOCK if tag not in BLOCK and tag not in MUTE else frozenset())
        if i:
            if tag in MUTE:
                self.stack[i].items.clear()
            self.pop_to(i)


#: What an opening block looks no further than for a paragraph to close.
EDGES_P = frozenset(("td", "th", "button", "table"))
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def parse(html: str) -> Node:
    """The page's tree, in time that grows with the page. Elements whose content isn't text for readers keep none."""
    root = Node("#root")
    held = Open(root)
    stack, at, size = held.stack, 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            stack[-1].items.append(html[at:begin])
        if begin == size:
            break
        at = begin
        nxt = html[at + 1 : at + 2]
        if nxt in ("!", "?") or (nxt == "/" and not (html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha())):
            comment = html.startswith("<!--", at)
            end = html.find("-->" if comment else ">", at + 2)  # <!--> is an empty comment
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        m = TAG.match(html, at)
        if not m:
            letter = html[at + 2 : at + 3] if nxt == "/" else nxt
            if letter.isascii() and letter.isalpha():  # a tag that the page's end cuts off
                break
            stack[-1].items.append("<")
            at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            held.close(tag)
            continue
        if tag in ENDS_P and held.ps[-1]:
            held.pop_to(held.last({"p"}))
        if tag in CLOSES:
            kinds, edge = CLOSES[tag]
            while i := held.last(kinds, edge):
                held.pop_to(i)
                if tag != "tr":
                    break
        node = Node(tag, m[3])
        stack[-1].items.append(node)
        if tag in RAW:
            end = RAW_ENDS[tag].search(html, at)
            at = end.end() if end else size
        elif tag in FOREIGN:
            if not m[4]:
                at = foreign_end(html, at, tag)
        elif tag not in VOID:
            held.push(node)
    return root


FOREIGN_EDGE = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)(svg|math|foreignobject|desc|title|annotation-xml|{"|".join(sorted(BLOCK))}|b|br|em|i|img|span|strong)(?=[\s/>])({ATTRS})(/?)>""", re.S | re.I)


def foreign_end(html: str, at: int, tag: str) -> int:
    """Where svg or math ends: after its end tag, or before an element of HTML, which ends it too; else nothing is skipped."""
    depth, hosts = 1, 0
    for m in FOREIGN_EDGE.finditer(html, at):
        if m[2] is None:
            continue
        name = m[2].lower()
        step = -1 if m[1] else 0 if m[4] else 1
        if name == tag:
            depth += step
            if not depth:
                return m.end()
        elif name in ("foreignobject", "desc", "title", "annotation-xml"):  # these hold HTML
            hosts += step
        elif name not in FOREIGN and not m[1] and hosts <= 0:
            return m.start()
    return at


_SEEN: dict[str, tuple[int, int, int]] = {}


def attribute_words(attrs: str) -> tuple[int, int, int]:
    """(words of boilerplate, words of articles, hidden) among an element's attributes; kept, as they recur."""
    known = _SEEN.get(attrs)
    if known is None:
        text = " ".join(a or b or c for a, b, c in ATTR.findall(attrs))
        words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()))
        known = len(words & BAD), len(words & GOOD), int(bool(HIDDEN.search(attrs)))
        if len(_SEEN) < 50_000:
            _SEEN[attrs] = known
    return known


#: Features of a node after its kind's indicators.
NUMBERS = 24


def flatten(root: Node) -> tuple[list[Node], list[int], np.ndarray, np.ndarray]:
    """(nodes in page order, their parents, features, characters of text that stand directly in each)."""
    order: list[Node] = []
    parents, depths, own, marks, at = [], [], [], [], []
    seen = 0
    stack: list[tuple[Node, int, int]] = [(root, -1, 0)]
    while stack:
        node, up, deep = stack.pop()
        i = len(order)
        order.append(node)
        parents.append(up)
        depths.append(deep)
        texts = [x for x in node.items if isinstance(x, str)]
        chars = sum(len(x.strip()) for x in texts)
        own.append(chars)
        marks.append(sum(x.count(",") + x.count(".") + x.count("?") + x.count("!") for x in texts))
        at.append(seen)
        seen += chars
        stack.extend((x, i, deep + 1) for x in reversed(node.items) if not isinstance(x, str))
    n = len(order)
    text, link, punct, count, paras = own[:], [0] * n, marks[:], [1] * n, [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    tags: list[Counter[str]] = [Counter() for _ in range(n)]
    places = [0] * n
    for i in range(n - 1, 0, -1):
        p = parents[i]
        tag = order[i].tag
        link[i] = text[i] if tag == "a" else link[i]
        text[p] += text[i]
        link[p] += link[i]
        punct[p] += punct[i]
        count[p] += count[i]
        paras[p] += paras[i] + (tag == "p")
        kids[p].append(i)
        tags[p][tag] += 1
        places[i] = len(kids[p])
    x = np.zeros((n, len(KINDS) + NUMBERS), np.float32)
    bad, good, gone, poor, fine = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    page = max(1, text[0])
    for i, node in enumerate(order):
        p = parents[i]
        kind = KIND_OF.get(node.tag, "inline")
        x[i, KINDS.index(kind)] = 1
        b, g, h = attribute_words(node.attrs) if node.attrs else (0, 0, 0)
        if p >= 0:
            bad[i], good[i], gone[i] = bad[p] + b, good[p] + g, gone[p] + h
            poor[i] = poor[p] + (kind in ("nav", "footer", "aside", "form") or kind == "header" and not fine[p])
            fine[i] = fine[p] + (kind in ("article", "main"))
        same = kids[p] if p >= 0 else [i]
        around = text[p] / len(same) if p >= 0 else text[i]
        place = len(same) - places[i] if p >= 0 else 0
        alike = tags[p][node.tag] / len(same) if p >= 0 else 1.0
        x[i, len(KINDS) :] = (
            b, g, bad[i] - b, good[i] - g, gone[i], poor[i], fine[i], depths[i], np.log1p(text[i]), np.log1p(own[i]), link[i] / max(1, text[i]),
            np.log1p(text[i] / count[i]), 100 * punct[i] / max(1, text[i]), paras[i], np.log1p(count[i]), text[i] / page, at[i] / page,
            place / len(same), len(same), alike, np.log1p(around), text[i] / max(1.0, around), len(kids[i]), link[p] / max(1, text[p]) if p >= 0 else 0,
        )
    return order, parents, x, np.array(own, float)


@dataclass
class Trees:
    """Boosted trees of equal depth: at each inner node a feature and a cut, at each leaf a value."""

    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, v in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Gradient boosting of the logistic loss, with histograms of each feature's quantiles."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = (y * weight).sum() / weight.sum()
    bias = float(np.log(share / (1 - share)))
    z = np.full(len(y), bias)
    inner, width = 2**depth - 1, bins + 1
    out_f, out_c, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = (y - p) * weight, p * (1 - p) * weight
        feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            base, n = 2**level - 1, 2**level
            local = at - base
            best_gain, best = np.full(n, 1e-6), [None] * n
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * width + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=n * width).reshape(n, width).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=n * width).reshape(n, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = np.where((hs > 1) & (ht - hs > 1), gain, 0)[:, : len(e)]
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(n), k] > best_gain):
                    best_gain[i], best[i] = gain[i, k[i]], (j, k[i])
            for i, b in enumerate(best):
                if b:
                    feature[base + i], cut[base + i] = b[0], edges[b[0]][b[1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
        z += value[leaf]
        out_f.append(feature)
        out_c.append(cut)
        out_v.append(value)
    return Trees(depth, np.array(out_f), np.array(out_c), np.array(out_v), bias)


def decode(parents: list[int], own: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Which nodes belong to the article: the best assignment without article nodes below boilerplate.

    Bottom up, each node gets the best total for being article, boilerplate, or a container without text of its own.
    """
    n = len(parents)
    pull = (np.clip(odds, -4, 4) * (0.3 + np.sqrt(own))).tolist()
    article, boiler, holder = pull[:], [-x for x in pull], [0.0 if o == 0 else -np.inf for o in own.tolist()]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        article[p] += max(article[i], boiler[i])
        boiler[p] += boiler[i]
        holder[p] += max(article[i], boiler[i], holder[i])
    state = [0] * n  # 0 boilerplate, 1 article, 2 container
    for i in range(n):
        up = state[parents[i]] if i else 2
        choices = [boiler[i]] + [article[i]] * (up >= 1) + [holder[i]] * (up == 2)
        state[i] = max(range(len(choices)), key=choices.__getitem__)
    return np.array(state) == 1


def blocks(root: Node, order: list[Node], keep: np.ndarray) -> list[str]:
    """Texts of the kept nodes in page order, one for each stretch between edges of block-level elements."""
    kept = {id(node) for node, k in zip(order, keep.tolist(), strict=True) if k}
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    stack: list[tuple[Node | str, bool, bool]] = [(root, False, False)]
    while stack:
        item, inside, leaving = stack.pop()
        if isinstance(item, str):
            if inside:
                held.append(item)
            continue
        block = item.tag in BLOCK or item.tag == "#root"
        if block:
            flush()
        elif item.tag in VOID:
            held.append(" ")
        if leaving:
            continue
        if block:
            stack.append((item, False, True))
        inside = id(item) in kept
        stack.extend((x, inside, False) for x in reversed(item.items))
    flush()
    return out


def prepared(html: str | None) -> tuple[Node, list[Node], list[int], np.ndarray, np.ndarray]:
    root = parse(html or "")
    return (root, *flatten(root))


def extract(pages: list[str | None], model: Trees) -> list[str]:
    """The main text of each page."""
    done = [prepared(p) for p in pages]
    if not done:
        return []
    odds = model(np.concatenate([d[3] for d in done]))
    out, at = [], 0
    for root, order, parents, x, own in done:
        keep = decode(parents, own, odds[at : at + len(x)])
        at += len(x)
        out.append("\n\n".join(blocks(root, order, keep)))
    return out


# --- made-up pages ---------------------------------------------------------------------------------------------------
def synthetic_page(rng: random.Random) -> Node:
    """A page of random layout whose nodes carry labels: 1 article, 0 boilerplate, -1 container of both."""

    def words(lo: int, hi: int, stop: bool = True) -> str:
        out = []
        for _ in range(rng.randint(lo, hi)):
            w = "".join(rng.choice("abcdefghiklmnoprstuvwyé") for _ in range(rng.randint(1, 11)))
            out.append(w + (rng.choice(",.") if stop and rng.random() < 0.12 else ""))
        return " ".join(out) + ("." if stop else "")

    def make(tag: str, label: int, items: list, names: str = "") -> Node:
        attr = f' {rng.choice(("class", "id"))}="{names}"' if names else ""
        node = Node(tag, attr)
        node.items, node.label = items, label
        return node

    def some(*names: str) -> str:
        return rng.choice(names) + rng.choice(("", "", f"-{rng.randint(1, 9)}", " " + words(1, 1, False)))

    def anchor(label: int, lo: int = 1, hi: int = 4) -> Node:
        return make("a", label, [words(lo, hi, False)])

    def menu(tag: str | None = None, names: str = "") -> Node:
        entries = [make("li", 0, [anchor(0)]) if rng.random() < 0.8 else anchor(0) for _ in range(rng.randint(2, 12))]
        inner = [make("ul", 0, entries)] if rng.random() < 0.7 else entries
        return make(tag or rng.choice(("nav", "nav", "div", "header")), 0, inner, names or some("nav", "menu", "top-nav", "main-menu", "breadcrumb") if rng.random() < 0.7 or tag == "div" else "")

    def boiler(kind: str) -> Node:
        para = lambda lo, hi: make("p", 0, [words(lo, hi)])
        if kind == "menu":
            return menu()
        if kind == "ad":
            inner = [words(3, 30)] if rng.random() < 0.6 else [para(3, 30)]
            return make(rng.choice(("div", "div", "aside", "section")), 0, inner, some("ad", "ads", "advert", "banner", "sponsor", "promo-box"))
        if kind == "header":
            return make("header", 0, [make(rng.choice(("h1", "h2", "div", "p")), 0, [words(1, 6, False)]), *([menu()] if rng.random() < 0.5 else [])], some("header", "masthead", "") if rng.random() < 0.5 else "")
        if kind == "footer":
            inner = [words(3, 40)] if rng.random() < 0.6 else [para(3, 40), menu("div")]
            return make(rng.choice(("footer", "footer", "div")), 0, inner, some("footer", "site-footer", "copyright"))
        if kind == "sidebar":
            inner = [make(rng.choice(("h3", "h4")), 0, [words(1, 4, False)]), menu("div", some("related", "widget", "recommended")), *([para(5, 40)] if rng.random() < 0.5 else [])]
            return make(rng.choice(("aside", "aside", "div")), 0, inner, some("sidebar", "widget", "right-rail", "aside"))
        if kind == "comments":
            one = lambda: make(rng.choice(("div", "li", "article")), 0, [make("b", 0, [words(1, 2, False)]), para(5, 60)], some("comment", "reply"))
            return make(rng.choice(("div", "section")), 0, [make("h3", 0, [words(1, 3, False)])] * (rng.random() < 0.5) + [one() for _ in range(rng.randint(1, 6))], some("comments", "disqus", "comment-list"))
        if kind == "notice":
            return make(rng.choice(("div", "section", "p")), 0, [words(5, 50), *([make("button", 0, [words(1, 2, False)])] if rng.random() < 0.6 else [])], some("cookie", "notice", "consent", "gdpr", "alert", "popup"))
        if kind == "form":
            return make("form", 0, [make("label", 0, [words(1, 4, False)]), make("input", 0, []), make("button", 0, [words(1, 2, False)])], some("search", "newsletter", "subscribe", "login") if rng.random() < 0.6 else "")
        return make("div", 0, [anchor(0) for _ in range(rng.randint(2, 6))], some("share", "social", "tags"))

    def paragraph() -> Node:
        size = rng.choice(((1, 4), (5, 30), (20, 90), (40, 160)))
        items: list = [words(*size)]
        if rng.random() < 0.25:
            items += [anchor(1), " ", words(2, 20)]
        if rng.random() < 0.25:
            items = [make(rng.choice(("b", "em", "span", "i")), 1, items)]
        if rng.random() < 0.1:
            items += [make("br", 1, []), words(3, 30)]
        return make("p", 1, items)

    def article() -> list:
        out: list = []
        if rng.random() < 0.8:
            out.append(make(rng.choice(("h1", "h1", "h2")), 1, [words(1, 14, False)]))
        for _ in range(rng.choice((1, 2, 4, 8, 12))):
            r = rng.random()
            if r < 0.75:
                out.append(paragraph())
            elif r < 0.82:
                out.append(make(rng.choice(("h2", "h3")), 1, [words(1, 8, False)]))
            elif r < 0.88:
                out.append(make(rng.choice(("ul", "ol")), 1, [make("li", 1, [words(2, 25)]) for _ in range(rng.randint(1, 6))]))
            elif r < 0.92:
                out.append(make("blockquote", 1, [paragraph()]))
            elif r < 0.95:
                out.append(make("table", 1, [make("tr", 1, [make("td", 1, [words(1, 6)]) for _ in range(3)]) for _ in range(rng.randint(1, 4))]))
            else:
                out.append(make("pre", 1, [words(5, 30)]))
        if rng.random() < 0.3:
            out.insert(rng.randint(0, len(out)), boiler(rng.choice(("ad", "share", "form", "notice", "sidebar"))))
        return out

    names = some("content", "article", "post", "entry-content", "story", "main", "text") if rng.random() < 0.6 else ""
    core = make(rng.choice(("article", "article", "main", "div", "section")), 1, article(), names)
    if core.tag in ("div", "section") and not names:
        core = make("main", -1, [core]) if rng.random() < 0.5 else core
    if rng.random() < 0.12:  # no wrapper at all
        middle: list = core.items
    else:
        middle = [core]
    above = [boiler(rng.choice(("menu", "ad", "header", "notice", "form", "menu"))) for _ in range(rng.randint(0, 4))]
    below = [boiler(rng.choice(("footer", "comments", "sidebar", "ad", "share", "form", "notice", "footer"))) for _ in range(rng.randint(0, 4))]
    inner = above + middle + below
    for _ in range(rng.choice((0, 0, 1, 2))):
        cut_ = rng.randint(0, len(above))
        inner = inner[:cut_] + [make("div", -1, inner[cut_:], some("wrapper", "container", "page", "layout") if rng.random() < 0.5 else "")]
        above = above[:cut_]
    body = make("body", -1, inner)
    head = make("head", 0, [make("meta", 0, []), make("title", 0, [])])
    root = Node("#root")
    root.items, root.label = [make("html", -1, [head, body])], -1
    return root


@lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 11) -> Trees:
    """The model, trained on made-up pages."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        order, _, x, own = flatten(synthetic_page(rng))
        y = np.array([n.label for n in order])
        at = y >= 0
        xs.append(x[at])
        ys.append(y[at])
        ws.append(1 + np.log1p(own[at]))
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def main_text(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                texts = extract(part.column(2).to_pylist(), model)
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
