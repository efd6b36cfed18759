"""HTML extraction: gradient-boosted trees over DOM-node features, then a hierarchical decoding.

A page becomes a tree of elements; each run of text between block boundaries is a leaf of its own. Trees score every
node for holding (some of) the article. Decoding picks the most likely labelling in which no descendant of a dropped
node is kept, and the kept leaves are the text. The trees are trained here on generated pages of many layouts, whose
nodes are known to be article or not; they take a few seconds and are the same on every run.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# --- pages to trees -------------------------------------------------------------------------------------------------

# The names and nesting rules of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
FOREIGN = frozenset("svg math".split())
BOXES = frozenset("button select option optgroup object audio video canvas".split())  # nodes of their own that may stand inside a paragraph
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
) | BOXES
CLOSES_P = BLOCK - BOXES - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"optgroup", "option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select", "optgroup"}, "optgroup": {"select"}}

# Groups of element names and of attribute tokens; each is one bit.
TAG_GROUPS = [
    "nav menu", "header hgroup", "footer", "aside", "form fieldset legend label input", "article main", "section", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd",
    "table tbody thead tfoot tr td th caption", "div center", "blockquote pre", "figure figcaption", "a", "body html", "dialog details summary", "#text",
]
TOKEN_GROUPS = [
    "ad ads advert advertisement adverts banner sponsor sponsored promo promoted promotion adsense adslot dfp commercial",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager topbar tabs skip",
    "footer foot bottom copyright legal colophon imprint contentinfo",
    "header masthead head top logo branding hero",
    "sidebar side aside widget widgets rail complementary",
    "comment comments commentlist disqus reply replies respond response responses discussion reader readers thread feedback",
    "notice cookie cookies consent gdpr popup modal overlay alert warning disclaimer paywall subscribe subscription newsletter signup login",
    "share social sharing follow facebook twitter tweet likes buttons toolbar tools",
    "related recommended recommendations similar popular trending more read next teaser teasers latest links",
    "byline author date time meta metadata tags tag category categories published posted caption credit",
    "article content post entry story main body text page single blog prose articlebody maincontent",
    "hidden invisible screenreader sr none offscreen",
    "search searchbox form input contact",
]
_tag_bit = {name: 1 << k for k, group in enumerate(TAG_GROUPS) for name in group.split()}
_token_bit = {name: 1 << (len(TAG_GROUPS) + k) for k, group in enumerate(TOKEN_GROUPS) for name in group.split()}
BITS = len(TAG_GROUPS) + len(TOKEN_GROUPS)
_TEXT, _LINK = _tag_bit["#text"], _tag_bit["a"]
_HIDDEN = _token_bit["hidden"]

_markup = re.compile(r"""<!--(?:.*?-->|.*+)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_comment = re.compile(r"<!--.*", re.S)  # where no markup can end any more, only a comment can still begin
_named = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_concealed = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_token = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@cache
def _ending(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I)


def _attribute_bits(attributes: str) -> int:
    bits = 0
    if "=" in attributes:
        for a, b, c in _named.findall(attributes):
            for token in _token.findall(a or b or c):
                bits |= _token_bit.get(token.lower(), 0)
    if _concealed.search(attributes):
        bits |= _HIDDEN
    return bits


class _Open:
    """The open elements: names and nodes from the outermost, and for each name and for all blocks the places where they
    stand, so that no question about them walks the whole stack."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def pop(self, to: int) -> None:
        while len(self.names) > to:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def node(self) -> int:
        return self.nodes[-1] if self.nodes else -1

    def last(self, name: str) -> int:
        """The innermost place of the name, -1 if it is not open."""
        at = self.places.get(name)
        return at[-1] if at else -1

    def count(self, name: str) -> int:
        return len(self.places.get(name, ()))

    def first_after(self, names: set[str], place: int) -> int:
        """The outermost place of any of the names further in than ``place``, -1 if there is none."""
        found = []
        for name in names:
            at = self.places.get(name, [])
            k = bisect.bisect_right(at, place)
            if k < len(at):
                found.append(at[k])
        return min(found, default=-1)


class Page:
    """Nodes in page order: bits of tag and attributes, parent (-1: none), depth, and of leaves the text and its link characters."""

    __slots__ = ("bits", "depth", "linked", "parent", "texts")

    def __init__(self, source: str) -> None:
        self.bits, self.parent, self.depth, self.texts, self.linked = [], [], [], [], []
        stack = _Open()
        run: list[str] = []
        run_linked, at, remembered, last_end = 0, 0, {}, source.rfind(">")

        def add(bits: int) -> int:
            up = stack.node()
            self.bits.append(bits)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
            self.texts.append("")
            self.linked.append(0)
            return len(self.bits) - 1

        def flush() -> None:
            nonlocal run_linked
            text = " ".join("".join(run).split())
            if text:
                node = add(_TEXT)
                self.texts[node], self.linked[node] = text, min(run_linked, len(text))
            run.clear()
            run_linked = 0

        def write(text: str) -> None:
            nonlocal run_linked
            if text:
                text = html.unescape(text) if "&" in text else text
                run.append(text)
                if stack.count("a"):
                    run_linked += len(text)

        n = len(source)
        while at < n:
            m = _markup.search(source, at) if at <= last_end else _comment.search(source, at)
            if m is None:
                write(source[at:])
                break
            if m.start() > at:
                write(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5]) if m.lastindex else None
            if name is None:
                continue
            name, closing, attributes = name.lower(), (m[1] or m[4]) == "/", (m[3] or m[6] or "")
            if closing:
                if name in BLOCK:
                    flush()
                k = stack.last(name)
                if k >= 0 and (name in BLOCK or not stack.blocks or stack.blocks[-1] < k):  # a stray end of an inline element does not end blocks
                    stack.pop(k)
                continue
            if name in RAW:
                if attributes.endswith("/") and any(stack.count(t) for t in FOREIGN):
                    continue
                end = _ending(name).search(source, at)
                at = end.end() if end else n
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                else:
                    run.append(" " if name == "br" else "")
                continue
            if name in BLOCK:
                flush()
                if name in CLOSES_P and stack.blocks and stack.names[stack.blocks[-1]] == "p":
                    stack.pop(stack.blocks[-1])
                if name in SIBLINGS:
                    found = stack.first_after(SIBLINGS[name], max(stack.last(t) for t in SCOPES[name]))
                    if found >= 0:
                        stack.pop(found)
                if attributes not in remembered:
                    remembered[attributes] = _attribute_bits(attributes)
                stack.push(name, add(_tag_bit.get(name, 0) | remembered[attributes]))
            elif name == "a":
                stack.push(name, stack.node())
            else:
                bits = _attribute_bits(attributes) if attributes else 0
                if bits & _HIDDEN:
                    flush()
                    stack.push(name, add(bits))
                else:
                    stack.push(name, stack.node())
            if attributes.endswith("/") and name not in BLOCK:
                stack.pop(len(stack.names) - 1)
        flush()


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, in order."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


# --- features -------------------------------------------------------------------------------------------------------


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all nodes of the pages, one after the other: features, parents, depths and the page of each."""
    sizes = np.array([len(p.bits) for p in pages])
    n, page = int(sizes.sum()), np.repeat(np.arange(len(pages)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    bits, depth, linked, up = flat("bits"), flat("depth"), flat("linked"), flat("parent")
    parent = np.where(up >= 0, up + begin, -1)
    texts = [t for p in pages for t in p.texts]
    chars = np.array([len(t) for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("?") + t.count("!") for t in texts], float)
    leaf = (bits & _TEXT > 0).astype(float)

    order, last = np.arange(n), np.arange(n)
    inherited = bits.copy()
    levels = by_depth(depth)
    for at in levels[1:]:
        inherited[at] |= inherited[parent[at]]
    for at in reversed(levels[1:]):
        np.maximum.at(last, parent[at], last[at])
    above = np.where(parent >= 0, inherited[parent], 0)

    def subtree(x: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(x)]
        return sums[last + 1] - sums[order]

    s_chars, s_links, s_stops, s_leaves, s_nodes = (subtree(x) for x in (chars, linked.astype(float), stops, leaf, np.ones(n)))
    s_par = subtree((bits & _tag_bit["p"] > 0).astype(float))
    whole = np.bincount(page, chars, len(pages))[page] if n else chars
    group = np.where(parent >= 0, parent, n + page)
    kids = np.bincount(group, minlength=n + len(pages) + 1)
    kid_chars = np.bincount(group, s_chars, n + len(pages) + 1)
    kid_links = np.bincount(group, s_links, n + len(pages) + 1)
    numbers = [
        np.log1p(s_chars), s_links / np.maximum(s_chars, 1), s_chars / s_nodes, s_stops / np.maximum(s_chars, 1) * 50, np.log1p(s_leaves), np.log1p(s_par), s_chars / np.maximum(whole, 1),
        depth.astype(float), (order - begin) / np.maximum(np.repeat(sizes, sizes), 1), np.log1p(kids[group]), s_chars / np.maximum(kid_chars[group], 1), kid_links[group] / np.maximum(kid_chars[group], 1),
        np.log1p(kid_chars[group] / np.maximum(kids[group], 1)), s_chars / np.maximum(s_leaves, 1),
    ]
    flags = [(x >> k & 1).astype(float) for x in (bits, above) for k in range(BITS)]
    return np.stack([*numbers, *flags], axis=1).astype(np.float32), parent, depth, page


# --- boosted trees --------------------------------------------------------------------------------------------------


class Boosted:
    """Trees of one depth, fitted to the logistic loss by Newton steps over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 24, rate: float = 0.25) -> None:
        self.count, self.depth, self.bins, self.rate = trees, depth, bins, rate

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = self.bin(x)
        width = max(len(c) for c in self.cuts) + 1
        flat = binned.astype(np.int64) + np.arange(m) * width
        score = np.zeros(n)
        self.feature = np.zeros((self.count, 2**self.depth - 1), np.int64)
        self.split = np.full((self.count, 2**self.depth - 1), 255, np.uint8)
        self.value = np.zeros((self.count, 2**self.depth))
        for t in range(self.count):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                nodes = 2**level
                key = (node[:, None] * (m * width) + flat).ravel()
                gs, hs = (np.bincount(key, np.repeat(v, m), nodes * m * width).reshape(nodes, m, width).cumsum(axis=2) for v in (g, h))
                ga, ha = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                gain[(hs < 1) | (ha - hs < 1)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                for k in range(nodes):
                    if gain[k].flat[best[k]] > 1e-3:
                        self.feature[t, nodes - 1 + k], self.split[t, nodes - 1 + k] = best[k] // width, best[k] % width
                at = nodes - 1 + node
                node = node * 2 + (binned[np.arange(n), self.feature[t, at]] > self.split[t, at])
            gsum, hsum = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.value[t] = self.rate * gsum / (hsum + 1)
            score += self.value[t][node]
        return self

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        binned, out, rows = self.bin(x), np.zeros(len(x)), np.arange(len(x))
        for t in range(self.count):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (binned[rows, self.feature[t, at]] > self.split[t, at])
            out += self.value[t][node]
        return out


def decode(score: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely labels in which every descendant of a dropped node is dropped, from log-odds."""
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    best = keep.copy()  # of the subtree if the node is kept
    levels = by_depth(depth)
    for at in reversed(levels[1:]):
        np.add.at(best, parent[at], np.maximum(best[at], drop[at]))
        np.add.at(drop, parent[at], drop[at])
    kept = np.zeros(len(score), bool)
    for d, at in enumerate(levels):
        kept[at] = (best[at] > drop[at]) & (kept[parent[at]] if d else True)
    return kept


# --- training pages -------------------------------------------------------------------------------------------------


def generated_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout and the blocks of its article, in order."""
    syllables = "an be co der en fi gra he in jo ka lu mi no or pe qua re sta ti un ve wo ya zu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", ",", "", "!"])
    prose = lambda: " ".join(sentence(1, 18) for _ in range(rng.randint(1, 12)))
    plain = rng.random() < 0.25  # attributes that say nothing

    def named(words: str) -> str:
        if plain and rng.random() < 0.6:
            return rng.choice(["", f' class="{word()}{rng.randint(0, 99)}"'])
        return rng.choice([f' class="{{}}"', f' id="{{}}"', f' class="{word()} {{}}"', ' class="{}-box"', ' class="site-{}"']).format(rng.choice(words.split()))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{sentence(1, 3)}</a></li>' for _ in range(k))

    def menu() -> str:
        k = rng.randint(2, 9)
        return rng.choice([
            lambda: f"<nav{named('nav menu')}><ul>{links(k)}</ul></nav>", lambda: f"<div{named('menu navigation navbar')}><ul>{links(k)}</ul></div>",
            lambda: "<nav>" + " | ".join(f'<a href="#">{word()}</a>' for _ in range(k)) + "</nav>", lambda: f"<ul{named('menu breadcrumbs toc')}>{links(k)}</ul>",
        ])()

    def advert() -> str:
        return f"<{(t := rng.choice(['div', 'aside', 'section', 'p']))}{' class=ad' if plain else named('ad ads advert sponsored banner promo')}>{rng.choice([prose, lambda: sentence(2, 9)])()}</{t}>"

    def head() -> str:
        t = rng.choice(["header", "div"])
        name = named("masthead branding topbar") if t == "header" else ' class="masthead"'
        return f"<{t}{name}>{rng.choice(['<h1>', '<p>', '<div>'])}{sentence(1, 4)}{rng.choice(['', menu()])}</{t}>"

    def foot() -> str:
        return rng.choice([
            lambda: f"<footer{named('footer bottom')}>&copy; {word()} &middot; {sentence(2, 8)}</footer>", lambda: f"<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>", lambda: f'<div id="footer">{sentence(3, 12)}</div>',
        ])()

    def side() -> str:
        return rng.choice([
            lambda: f"<aside{named('sidebar widget related')}><h3>{sentence(1, 3)}</h3><ul>{links(rng.randint(2, 6))}</ul></aside>", lambda: f'<div class="sidebar"><p>{prose()}</p></div>', lambda: f"<aside><p>{prose()}</p></aside>",
            lambda: f"<div{' class=related' if plain else named('related popular trending')}><h4>{word()}</h4><ul>{links(4)}</ul></div>",
        ])()

    def notice() -> str:
        return f"<div{' class=notice' if plain else named('notice cookie consent newsletter alert disclaimer subscribe')}><p>{sentence(4, 20)}</p>{rng.choice(['', '<button>OK</button>'])}</div>"

    def form() -> str:
        return f"<form action=/{word()}><label>{sentence(1, 3)}</label><input name=q>{rng.choice(['', f'<p>{sentence(3, 9)}</p>'])}<button>{word()}</button></form>"

    def remarks() -> str:
        t = rng.choice(["div", "section", "ol", "ul"])
        inner, item = ("li", "li") if t in ("ol", "ul") else (rng.choice(["div", "p", "article"]), "p")
        body = "".join(f'<{inner}{named("comment reply")}><{item if inner != "p" else "span"}>{prose()}</{item if inner != "p" else "span"}></{inner}>' for _ in range(rng.randint(1, 6)))
        return f"<{t}{rng.choice([' id=comments', ' class=comments', ' class=discussion', ' class=replies', ' id=responses'])}><h3>{sentence(1, 3)}</h3>{body}</{t}>".replace("<ol", "<ol").replace("<h3>", "<li>" if t in ("ol", "ul") else "<h3>")

    def share() -> str:
        return f'<div class="{rng.choice(["share", "social", "sharing-tools"])}">' + "".join(f'<a href="#">{word()}</a> ' for _ in range(rng.randint(2, 5))) + "</div>"

    junk = [menu, advert, side, notice, form, share, remarks]
    blocks: list[str] = []

    def kept(text: str) -> str:
        blocks.append(text)
        return text

    def part() -> str:
        kind = rng.random()
        if kind < 0.72:
            style = rng.random()
            text = kept(prose() if rng.random() < 0.85 else sentence(1, 3))
            if style < 0.15:
                return f"<p><b>{text}<br>"
            if style < 0.25:
                first, _, rest = text.partition(" ")
                return f'<p><a href="#">{first}</a>{" " + rest if rest else ""}</p>'
            return f"<p>{text}</p>"
        if kind < 0.82:
            return f"<h2>{kept(sentence(2, 6))}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{kept(sentence(3, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.96:
            return f"<blockquote><p>{kept(prose())}</p></blockquote>"
        return "<table>" + "".join(f"<tr><td>{kept(word())}</td><td>{kept(sentence(1, 4))}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"

    body = f"<h1>{kept(sentence(2, 12))}</h1>" if rng.random() < 0.85 else ""
    for _ in range(rng.randint(1, 14)):
        body += part()
        if rng.random() < 0.07:
            body += rng.choice([advert, share, notice, side])()
    if rng.random() < 0.15:
        body += remarks()
    shape = rng.random()
    if shape < 0.5:
        body = f"<article{named('post entry story') if rng.random() < 0.4 else ''}>{body}</article>"
    elif shape < 0.7:
        body = f"<main>{body}</main>"
    elif shape < 0.8:
        body = f"<main><article>{body}</article></main>"
    else:
        body = f"<div{rng.choice([' id=content', ' class=article', ' class=post-content', ' class=entry-content', ' role=main', ' class=story'])}>{body}</div>"
    before = [f() for f in rng.choices([menu, head, advert, notice, form, side], k=rng.randint(0, 4))]
    after = [f() for f in rng.choices(junk, k=rng.randint(0, 3))] + ([foot()] if rng.random() < 0.85 else [])
    inner = "".join(before) + f"<!-- {word()} -->" + body + "".join(after)
    if rng.random() < 0.3:
        inner = f"<div{named('page wrapper container')}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inner}</body></html>", blocks


@cache
def trained(pages: int = 500, seed: int = 23) -> Boosted:
    rng = random.Random(seed)
    parsed, labels = [], []
    for _ in range(pages):
        source, blocks = generated_page(rng)
        page, left = Page(source), 0
        mark = np.zeros(len(page.bits))
        wanted = [" ".join(html.unescape(b).split()) for b in blocks]
        for k, text in enumerate(page.texts):
            if left < len(wanted) and text == wanted[left]:
                mark[k], left = 1, left + 1
        for k in range(len(mark) - 1, -1, -1):
            if mark[k] and page.parent[k] >= 0:
                mark[page.parent[k]] = 1
        parsed.append(page)
        labels.append(mark)
    x, _, _, _ = features(parsed)
    y = np.concatenate(labels)
    return Boosted().fit(x, y, np.where(x[:, 0] > 0, 1.0, 0.2))


def extract(sources: list[str | None], model: Boosted) -> list[str]:
    """The main texts of pages; an empty page has none."""
    pages = [Page(s or "") for s in sources]
    if not any(p.bits for p in pages):
        return ["" for _ in pages]
    x, parent, depth, page = features(pages)
    kept = decode(model.score(x), parent, depth)
    out: list[list[str]] = [[] for _ in pages]
    texts = [t for p in pages for t in p.texts]
    for k in np.flatnonzero(kept).tolist():
        if texts[k]:
            out[page[k]].append(texts[k])
    return ["\n".join(o) for o in out]


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, null html as an empty page, with no text.

    Nulls in page_id and url pass through; rows are independent, so repeated ones give repeated results. Character
    references are decoded, white space inside a block becomes one space, blocks are joined by a line feed in page order.
    Other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("html").to_pylist()
            texts: list[str] = []
            step = max(1, math.ceil(len(sources) / 8))
            for k in range(0, len(sources), step):
                texts += extract(sources[k : k + step], model.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
