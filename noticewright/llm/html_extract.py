"""Main text of web pages: boosted trees over DOM nodes, decoded top down.

A page is read into a tree of block elements. Gradient-boosted trees give each node the chance that
it belongs to the article, from the density of its subtree, its attribute tokens, its depth and its
siblings. Decoding gives every node one of three states: part of the article, container of some, or
outside. What lies outside holds nothing of the article, and a container can't stand inside the
article, so ancestor and descendant never contradict each other; of all such labellings the
likeliest is taken.

The trees are trained here, on labelled pages that ``authored_page`` draws from its layouts with a
fixed seed: ``TRAIN_PAGES`` of them, a bound that doesn't depend on the input.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

TRAIN_PAGES = 1600
TREES, DEPTH, RATE, BINS = 80, 5, 0.2, 32
#: Elements that hold the article and everything else alike: their tags say nothing.
NEUTRAL = frozenset(("#root", "html", "body", "head"))
#: Pages whose nodes are scored together.
TOGETHER = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page: code, fallbacks that aren't shown, form controls.
#: Without an end tag only scripts and styles hold the rest of the page; of the others the text up to the next tag goes.
CODE = frozenset(("script", "style"))
HIDDEN = CODE | frozenset("textarea title noscript template iframe canvas audio video select datalist button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold blocks rather than a line of text.
HOLDERS = frozenset("#root html body div section article main aside header footer nav form center td li".split())
#: Start tags that end an open paragraph, and the elements that a start tag of the same kind ends.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody")}
HOLDS = frozenset("ul ol dl table body article section div main aside".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
AFTER = re.compile(r"\s*(?:\Z|</?([a-zA-Z][^\s/>]*))")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Block nodes in page order, a parent before its children, and the texts between them."""

    tag: list = field(default_factory=lambda: ["#root"])
    parent: list = field(default_factory=lambda: [-1])
    depth: list = field(default_factory=lambda: [0])
    tokens: list = field(default_factory=lambda: [()])
    texts: list = field(default_factory=list)  # (node, text, inside a link); text None: a border
    marks: list = field(default_factory=lambda: [None])  # labels of authored pages


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with the block node they stand in
    links = at = 0
    ends: dict[str, re.Pattern] = {}

    def put(text: str) -> None:
        if text:
            page.texts.append((stack[-1][1], entities.unescape(text) if "&" in text else text, links > 0))

    def close(depth: int) -> None:
        nonlocal links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
        node = stack[depth][1]
        del stack[depth:]
        if stack[-1][1] != node:
            page.texts.append((stack[-1][1], None, False))

    def opened(tags, barrier) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in barrier:
                return 0
        return 0

    def bound(tag: str) -> re.Pattern:
        """The next end (group 1) or start of ``tag``."""
        return ends.get(tag) or ends.setdefault(tag, re.compile(rf"<(/?){tag}\b[^>]*>", re.I))

    def alone(tag: str) -> bool:
        """Whether a span stands among blocks, not in a line of text: no text before it, none after."""
        if stack[-1][0] not in HOLDERS:
            return False
        for node, text, _ in reversed(page.texts):
            if text is None or node != stack[-1][1]:
                break
            if text.strip():
                return False
        m2 = next((x for x in bound(tag).finditer(source, at) if x[1]), None)
        m3 = m2 and AFTER.match(source, m2.end())
        return bool(m3) and (m3[1] or "div").lower() not in INLINE

    while True:
        m = TAG.search(source, at)
        if not m:
            put(source[at:])
            break
        put(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, slash, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if slash:
            if i := opened((tag,), ()):
                close(i)
            elif tag == "p":
                page.texts.append((stack[-1][1], None, False))
            continue
        if tag in HIDDEN:
            if not attributes.endswith("/"):
                m2 = bound(tag).search(source, at)
                if m2 and (m2[1] or tag in CODE):
                    m2 = m2 if m2[1] else next((x for x in bound(tag).finditer(source, at) if x[1]), None)
                    at = m2.end() if m2 else len(source)
                elif tag in CODE or (at := source.find("<", at)) < 0:
                    at = len(source)
            continue
        if tag in ENDS_P and (i := opened(("p",), HOLDS)):
            close(i)
        if tag in ENDS and (i := opened(ENDS[tag], HOLDS)):
            close(i)
        if tag == "a" and links and (i := opened(("a",), HOLDS)):
            close(i)
        here = stack[-1][1]
        if tag == "br" or tag == "hr":
            page.texts.append((here, None, False))
        if tag in VOID:
            continue
        named = tuple(t.lower() for a in ATTRIBUTE.findall(attributes) for t in TOKEN.findall(a[0] or a[1] or a[2])) if "=" in attributes else ()
        links += tag == "a"
        if tag in INLINE and not (named and tag in ("span", "ins") and alone(tag)):
            stack.append((tag, here))
            continue
        page.texts.append((here, None, False))
        page.tag.append(tag)
        page.parent.append(here)
        page.depth.append(page.depth[here] + 1)
        page.tokens.append(named)
        page.marks.append("keep" if "data-keep" in attributes else "drop" if "data-drop" in attributes else None)
        stack.append((tag, len(page.tag) - 1))
    return page


FEATURES = 30


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """A row per node. ``odds``: log-odds of tags ("<p>") and attribute tokens ("sidebar")."""
    n = len(page.tag)
    own, linked, marks, words, chunks = ([0] * n for _ in range(5))
    position, total = [0] * n, 0
    seen = [False] * n
    for node, text, link in page.texts:
        if not seen[node]:
            seen[node], position[node] = True, total
        if text is None or not (size := len(text.strip())):
            continue
        own[node] += size
        total += size
        chunks[node] += 1
        words[node] += text.count(" ") + 1
        marks[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        if link:
            linked[node] += size
    sub, sub_linked, sub_marks, sub_words, sub_chunks = own[:], linked[:], marks[:], words[:], chunks[:]
    nodes, ps, forms, heads = [1] * n, [0] * n, [0] * n, [0] * n
    children, order, alike, same = [0] * n, [0] * n, [{} for _ in range(n)], [0] * n
    for i in range(n - 1, 0, -1):
        p, tag = page.parent[i], page.tag[i]
        for a in (sub, sub_linked, sub_marks, sub_words, sub_chunks, nodes, ps, forms, heads):
            a[p] += a[i]
        ps[p] += tag == "p"
        forms[p] += tag == "form" or tag == "fieldset"
        heads[p] += tag in ("h1", "h2", "h3")
    for i in range(1, n):
        p = page.parent[i]
        order[i] = children[p]
        children[p] += 1
        alike[p][page.tag[i]] = alike[p].get(page.tag[i], 0) + 1
    out = np.zeros((n, FEATURES), dtype=np.float32)
    whole = max(1, total)
    above = [0.0] * n
    below = [0.0] * n
    for i in range(n):
        p = page.parent[i]
        tag = odds.get(f"<{page.tag[i]}>", 0.0)
        named = [odds.get(t, 0.0) for t in page.tokens[i]]
        least, most = min(named, default=0.0), max(named, default=0.0)
        mine = min(tag, least)
        above[i] = min(mine, above[p]) if p >= 0 else mine
        below[i] = max(tag, most, below[p]) if p >= 0 else max(tag, most)
        same[i] = alike[p].get(page.tag[i], 0) if p >= 0 else 1
        s = sub[i]
        outer = sub[p] if p >= 0 else s
        out[i] = (
            tag, least, most, sum(named), above[p] if p >= 0 else 0, below[p] if p >= 0 else 0,
            page.depth[i], order[i], children[p] if p >= 0 else 1, same[i], order[i] / (children[p] if p >= 0 else 1),
            children[i], nodes[i], math.log1p(s), math.log1p(own[i]), s / whole, s / max(1, outer),
            sub_linked[i] / s if s else 0, sub_linked[p] / outer if p >= 0 and outer else 0, sub_marks[i] / s if s else 0,
            sub_words[i] / max(1, sub_chunks[i]), s / nodes[i], ps[i], forms[i], heads[i],
            position[i] / whole, len(named), odds.get(f"<{page.tag[p]}>", 0.0) if p >= 0 else 0, math.log1p(outer / max(1, nodes[p] if p >= 0 else 1)), ps[p] if p >= 0 else 0,
        )
    return out


# -- Gradient-boosted trees ------------------------------------------------------------------------


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> dict:
    """Logistic loss, histogram splits, complete trees of one depth (a split that gains nothing
    sends every row left)."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    margin = np.full(len(y), start)
    which, where, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, limit = np.zeros(len(y), dtype=np.int64), [], []
        for level in range(depth):
            n = 1 << level
            best, at, cut = np.full(n, 1e-6), np.zeros(n, dtype=np.int64), np.full(n, bins)
            for f in range(x.shape[1]):
                key = node * (bins + 1) + binned[:, f]
                gs = np.bincount(key, g, n * (bins + 1)).reshape(n, -1).cumsum(axis=1)
                hs = np.bincount(key, h, n * (bins + 1)).reshape(n, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                b = gain.argmax(axis=1)
                got = gain[np.arange(n), b]
                better = got > best
                best[better], at[better], cut[better] = got[better], f, b[better]
            feature += at.tolist()
            limit += [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(at, cut, strict=True)]
            node = node * 2 + (binned[np.arange(len(y)), at[node]] > cut[node])
        value = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
        margin += value[node]
        which.append(feature)
        where.append(limit)
        leaves.append(value)
    return {"start": start, "depth": depth, "feature": np.array(which), "limit": np.array(where, dtype=np.float32), "leaf": np.array(leaves)}


def chances(model: dict, x: np.ndarray) -> np.ndarray:
    margin, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for feature, limit, leaf in zip(model["feature"], model["limit"], model["leaf"], strict=True):
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(model["depth"]):
            k = (1 << level) - 1 + node
            node = node * 2 + (x[rows, feature[k]] > limit[k])
        margin += leaf[node]
    return 1 / (1 + np.exp(-margin))


# -- Decoding --------------------------------------------------------------------------------------


def decode(page: Page, chance: np.ndarray) -> list[bool]:
    """The likeliest consistent labelling: which nodes' own texts belong to the article."""
    n = len(page.tag)
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    keep, drop, hold = yes[:], no[:], no[:]  # the best of the subtree, if the node is in that state
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
        hold[up] += max(keep[i], drop[i], hold[i])
    state = [""] * n
    state[0] = "hold"
    for i in range(1, n):
        up = state[page.parent[i]]
        if up == "drop" or (keep[i] <= drop[i] and (up == "keep" or hold[i] <= drop[i])):
            state[i] = "drop"
        else:
            state[i] = "keep" if up == "keep" or keep[i] >= hold[i] else "hold"
    return [s == "keep" for s in state]


def text_of(page: Page, kept: list[bool]) -> str:
    return " ".join("".join([" " if text is None else text if kept[node] else "" for node, text, _ in page.texts]).split())


# -- Authored training pages -----------------------------------------------------------------------

SYLLABLES = "ka lo mi ren tur sa vel or an ti po est ul dra ne si tor ma in ge".split()
MAIN = ["article", 'div class="post-content"', 'div id="content"', 'div class="entry-content"', 'main', 'div class="article-body"', 'section class="story"', 'div class="main-content" role="main"', 'div itemprop="articleBody"', 'td class="content"', 'div class="post"', 'div class="text"', "div", "section"]
MENU = ["nav", 'div class="menu"', 'ul class="nav navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'ul class="topmenu"', 'nav aria-label="Main menu"', 'div class="pagination"', 'div class="toc"']
HEAD = ["header", 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'div class="top-bar"', 'div class="banner" role="banner"']
FOOT = ["footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="bottom"']
SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar-right"', 'div class="widget"', 'div class="related"', 'section class="related-posts recommended"', 'div class="popular"', 'div class="tags"', 'div class="rightcol"', 'aside class="side promo-box"']
NOTICE = ['div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner" role="dialog"', 'div class="alert" role="alert"', 'div class="gdpr consent"', 'div class="popup modal"', 'div class="subscribe-notice"', 'section class="announcement"']
ADVERT = ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div id="ad-slot"', 'ins class="adsbygoogle"', 'div class="promo"', 'aside class="ad-box"', 'p class="ad"']
FORM = ["form", 'form class="newsletter"', 'form id="search"', 'div class="search-form"', 'div class="login"', 'form class="subscribe"', 'form class="contact-form"']
COMMENT = ['section id="comments"', 'div class="comments"', 'div id="disqus-thread"', 'ol class="comment-list"', 'div class="comment-area replies"', 'section class="reader-comments"', 'div class="discussion"', 'div class="responses"']
SHARE = ['div class="share"', 'ul class="social"', 'div class="share-buttons"', 'div class="social-links"']


def authored_page(rng: random.Random) -> str:
    """A page whose elements say where the article is: data-keep or data-drop, inherited."""
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.choice((1, 1, 2, 2, 3))))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 16).capitalize() + rng.choice((".", ".", ".", "!", "?", ", " + words(2, 6) + "."))
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    shut = rng.random() < 0.85  # whether end tags that may be left out are written

    def el(tag: str, inner: str, mark: str = "") -> str:
        name = tag.split()[0]
        end = "" if name in ("p", "li") and not shut and rng.random() < 0.7 else f"</{name}>"
        return f"<{tag}{mark}>{inner}{end}"

    def links(a, b):
        many = [link() for _ in range(rng.randint(a, b))]
        return el("ul", "".join(el("li", x) for x in many)) if rng.random() < 0.7 else " | ".join(many)

    def aside():
        kind = rng.random()
        inner = links(2, 9) if kind < 0.5 else el("h3", words(1, 3)) + links(2, 6) if kind < 0.7 else el("p", prose(1, 3)) if kind < 0.85 else prose(1, 3)
        return el(rng.choice(SIDE), inner, " data-drop")

    def advert():
        return el(rng.choice(ADVERT), rng.choice((lambda: prose(1, 3), lambda: words(2, 12), lambda: link() + " " + prose(1, 2), lambda: el("p", prose(1, 2))))(), " data-drop")

    def notice():
        return el(rng.choice(NOTICE), rng.choice((lambda: prose(1, 3), lambda: el("p", prose(1, 3)) + link()))(), " data-drop")

    def form():
        return el(rng.choice(FORM), rng.choice((lambda: el("label", words(1, 3)), lambda: el("p", prose(1, 2)) + el("label", words(1, 2)), lambda: words(1, 6)))() + "<input name=q>" + el("button", words(1, 2)), " data-drop")

    def comments():
        one = lambda: el(rng.choice(("div class=\"comment\"", "li class=\"comment\"", "div", "article class=\"comment\"")), rng.choice((lambda: el("p", prose(1, 4)), lambda: el("span class=\"author\"", words(1, 2)) + el("p", prose(1, 3)), lambda: prose(1, 3)))())
        return el(rng.choice(COMMENT), el("h3", words(1, 3)) * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 6))) + (form() if rng.random() < 0.4 else ""), " data-drop")

    def share():
        return el(rng.choice(SHARE), links(2, 5), " data-drop")

    def block():
        kind = rng.random()
        if kind < 0.68:
            text = prose(1, 6) if rng.random() < 0.7 else prose(1, 1) if rng.random() < 0.5 else words(1, 6)
            if rng.random() < 0.2:
                text = f"<b>{text}<br>" if rng.random() < 0.5 else f"{text} <em>{words(1, 3)}</em> {link()} {sentence()}"
            return el("p", text)
        if kind < 0.78:
            return el(rng.choice(("h2", "h3", "h4")), words(1, 6))
        if kind < 0.86:
            return el(rng.choice(("ul", "ol")), "".join(el("li", rng.choice((sentence, lambda: words(1, 5)))()) for _ in range(rng.randint(2, 6))))
        if kind < 0.90:
            return el("blockquote", rng.choice((lambda: prose(1, 2), lambda: el("p", prose(1, 2))))())
        if kind < 0.93:
            return el("pre", words(3, 20))
        if kind < 0.96:
            return el("figure", "<img src=x>" + el("figcaption", sentence()))
        if kind < 0.98:
            return el("table", "".join(el("tr", "".join(el("td", words(1, 3)) for _ in range(3))) for _ in range(rng.randint(2, 4))))
        return el(rng.choice(("div", "section")), "".join(el("p", prose(1, 4)) for _ in range(rng.randint(1, 3))))

    body = [block() for _ in range(rng.choice((0, 1, 1, 1, 1, 2, 2, 3, 4, 6, 8, 12)))] or [el("p", words(1, 8))]
    for inside, chance in ((advert, 0.25), (aside, 0.15), (share, 0.15), (notice, 0.1), (form, 0.1)):
        if rng.random() < chance:
            body.insert(rng.randint(0, len(body)), inside())
    title = el("h1", words(1, 10))
    if rng.random() < 0.15:
        title = el("header", title)
    tail = comments() if rng.random() < 0.15 else ""
    article = el(rng.choice(MAIN), title * (rng.random() < 0.85) + "".join(body) + tail, " data-keep")
    if rng.random() < 0.4:
        article = el(rng.choice(("main", 'div class="container"', 'div id="wrapper"', 'div class="row"', "div")), article + (comments() if rng.random() < 0.4 else "") + (share() if rng.random() < 0.2 else ""))
    before = [f() for f, c in ((lambda: el(rng.choice(HEAD), el("div", words(1, 4)) + (el(rng.choice(MENU), links(2, 6)) if rng.random() < 0.5 else "") + (el("p", sentence()) if rng.random() < 0.3 else ""), " data-drop"), 0.6), (lambda: el(rng.choice(MENU), links(2, 10), " data-drop"), 0.75), (notice, 0.3), (advert, 0.45), (form, 0.2), (aside, 0.2)) if rng.random() < c]
    after = [f() for f, c in ((comments, 0.3), (aside, 0.45), (advert, 0.3), (form, 0.25), (share, 0.1), (notice, 0.2)) if rng.random() < c]
    last = el(rng.choice(FOOT), rng.choice((lambda: "&copy; " + words(1, 6), lambda: links(2, 6) + el("p", "&copy; " + sentence()), lambda: prose(1, 3)))(), " data-drop") if rng.random() < 0.9 else ""
    rng.shuffle(before)
    rng.shuffle(after)
    inner = "".join(before) + article + "".join(after) + last
    if rng.random() < 0.3:
        inner = el(rng.choice(('div id="page"', 'div class="wrapper"', "div", 'div class="site"')), inner)
    script = "<script>var a='</p>';</script><style>p{margin:0}</style>" * rng.randint(0, 1)
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title>{script}</head><body>{inner}</body></html>"


def labels_of(page: Page) -> np.ndarray:
    mine = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        mine[i] = mine[page.parent[i]] if page.marks[i] is None else page.marks[i] == "keep"
    return np.array(mine, dtype=float)


def train(pages: int = TRAIN_PAGES, seed: int = 7) -> dict:
    """{odds, trees...}: token log-odds come from one half of the authored pages, the trees from
    the other, so that the trees learn how far unseen tokens can be trusted."""
    rng = random.Random(seed)
    drawn = [parse(authored_page(rng)) for _ in range(pages)]
    counts: dict[str, list[float]] = {}
    for page in drawn[: pages // 2]:
        for i, y in enumerate(labels_of(page)):
            for t in {f"<{page.tag[i]}>", *page.tokens[i]} if page.tag[i] not in NEUTRAL else ():
                counts.setdefault(t, [1.0, 1.0])[int(y)] += 1
    odds = {t: math.log(b / a) for t, (a, b) in counts.items()}
    rest = drawn[pages // 2 :]
    x = np.concatenate([features(p, odds) for p in rest])
    y = np.concatenate([labels_of(p) for p in rest])
    # Every fourth page with its tokens unknown: density and siblings must do.
    plain = [features(p, {t: v for t, v in odds.items() if t[0] == "<"}) for p in rest[::4]]
    x = np.concatenate([x, *plain])
    y = np.concatenate([y, *[labels_of(p) for p in rest[::4]]])
    return boost(x, y) | {"odds": odds}


def extract_many(sources: list[str], model: dict) -> list[str]:
    out = []
    for lo in range(0, len(sources), TOGETHER):
        pages = [parse(s) for s in sources[lo : lo + TOGETHER]]
        rows = [features(p, model["odds"]) for p in pages]
        chance = chances(model, np.concatenate(rows))
        at = 0
        for page, r in zip(pages, rows, strict=True):
            out.append(text_of(page, decode(page, chance[at : at + len(r)])))
            at += len(r)
    return out


def extract(pages: DataFrame, model: dict | None = None, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page as ``out`` (with underscores behind it if the name is taken).

    A null, empty or article-less page has an empty text; broken markup is read as browsers do,
    roughly; whole pages are read, whatever their length. Rows are independent: repeated rows, empty
    tables and further columns are no matter."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series(extract_many(["" if s is None or s is pd.NA else s for s in sources], shared.value), dtype=object)

    return pages.withColumn(free_name(pages, out), extracted(F.col(html_col)))


def op10_html(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
