"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

A small lenient parser builds the block structure of a page. Every block element gets features of its tag, its
class and id tokens, its depth and siblings, and of its subtree (text, links, tags, sentences). A boosted-tree
model, trained here on generated pages with known answers, gives each block the log-odds of belonging to the
article. Text that stands in the page or body itself is a block of its own there, tagged #text. Decoding is hierarchical: a block is kept only if all its ancestors are, and the set of kept blocks is
the one with the greatest sum of log-odds under that rule, found bottom-up; so no ancestor contradicts a descendant.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

#: Fixed values of HTML: elements without content, with raw text, that start blocks, and that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "head button select option label".split()
)
ENDS_P = BLOCKS - frozenset("html body head td th tr tbody thead tfoot button select option label".split())
#: An open element of the first kind ends when one of the second begins.
IMPLIED = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
WALLS = frozenset("table td th ul ol dl select html body".split())
#: Elements whose own text is dealt to #text blocks.
LOOSE = frozenset(["#page", "html", "body"])
#: Which open elements a beginning block ends.
_ENDED = {name: tuple(x for x, by in IMPLIED.items() if name in by) for name in BLOCKS}
#: Word lists of the features: what attribute tokens suggest.
GOOD = frozenset("article content main post story entry body text page prose blog news copy hentry maincontent articlebody".split())
BAD = {
    "menu": frozenset("nav menu navigation navbar breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip links toc".split()),
    "head": frozenset("header masthead banner branding logo hero site".split()),
    "foot": frozenset("footer foot copyright legal colophon bottom imprint".split()),
    "side": frozenset("sidebar side aside widget rail related recommended popular trending tags more teaser".split()),
    "ad": frozenset("ad ads advert advertisement adsense sponsor sponsored promo promotion dfp outbrain taboola affiliate".split()),
    "note": frozenset("cookie cookies consent notice gdpr popup modal overlay alert newsletter subscribe signup paywall warning".split()),
    "talk": frozenset("comment comments reply replies discussion disqus respond thread commentlist".split()),
    "form": frozenset("form search login share sharing social follow rating poll".split()),
}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body", "#text"]

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_LEGAL = re.compile("\u00a9|&copy;|copyright|rights reserved", re.IGNORECASE)
#: Where raw text ends, found in the source itself: lower-casing can lengthen a text.
_RAW_END = {name: re.compile("</" + name, re.IGNORECASE | re.ASCII) for name in RAW | {"xmp"}}


class Page:
    """Block elements in page order: tag, attribute tokens, parent, depth; texts: (block, piece) in page order.

    Inline elements belong to the block around them; a piece of None marks where a child block or a rule stands, which
    ends the line of text before it.
    """

    __slots__ = ("depth", "links", "parent", "tags", "texts", "tokens")

    def __init__(self, source: str):
        self.tags, self.tokens, self.parent, self.depth = ["#page"], [()], [-1], [0]
        self.texts: list[tuple[int, str | None]] = []
        self.links: list[int] = [0]  # characters of text inside links, by block
        self._parse(source)

    def _block(self, name: str, up: int, words: list[str]) -> int:
        self.tags.append(name)
        self.tokens.append(tuple(words))
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.links.append(0)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        tags, texts, links = self.tags, self.texts, self.links
        stack: list[tuple[str, int]] = [("#page", 0)]  # open elements with the block they are in
        # how many of each name are open: at all; above the topmost wall; above the topmost block. rows: for each open
        # table (and the page) where in the stack its open rows and cells are. So no step searches in vain.
        total, walls, inline, rows, wall = Counter(), [Counter()], [Counter()], [[]], ["#page"]
        at, now, loose = 0, 0, -1

        def push(name: str, block: int) -> None:
            total[name] += 1
            walls[-1][name] += 1
            if name in BLOCKS:
                inline.append(Counter())
            else:
                inline[-1][name] += 1
            if name in WALLS:
                walls.append(Counter())
                wall.append(name)
            if name == "table":
                rows.append([])
            elif name in ("tr", "td", "th"):
                rows[-1].append(len(stack))
            stack.append((name, block))

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                name, _ = stack.pop()
                if name == "table":
                    rows.pop()
                elif name in ("tr", "td", "th"):
                    rows[-1].pop()
                if name in WALLS:
                    walls.pop()
                    wall.pop()
                if name in BLOCKS:
                    inline.pop()
                else:
                    inline[-1][name] -= 1
                walls[-1][name] -= 1
                total[name] -= 1

        def topmost(names: tuple[str, ...]) -> int:
            i = len(stack) - 1
            while stack[i][0] not in names:
                i -= 1
            return i

        def say(text: str) -> None:
            nonlocal loose
            to = now
            if tags[now] in LOOSE:
                if loose < 0 and not text.isspace():
                    loose = self._block("#text", now, [])
                to = loose if loose >= 0 else now
            texts.append((to, text))
            if total["a"]:
                links[to] += len(text)

        for m in iter(lambda: _TAG.search(source, at), None):
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                found = total[name] if name in BLOCKS else inline[-1][name]
                if found:
                    close(topmost((name,)))
                    now, loose = stack[-1][1], -1 if name in BLOCKS else loose
                continue
            if name in RAW:
                if (m[3] or m[6] or "").endswith("/") and name == "svg":
                    continue
                end = _RAW_END[name].search(source, at)
                last = source.find(">", end.start()) if end else -1
                at = len(source) if last < 0 else last + 1
                continue
            if name == "xmp":  # its text has no tags or entities, and is kept
                end = _RAW_END[name].search(source, at)
                if text := source[at : end.start() if end else len(source)]:
                    say(html.escape(text, quote=False))
                last = source.find(">", end.start()) if end else -1
                at = len(source) if last < 0 else last + 1
                continue
            if name == "br":
                say(" ")
                continue
            if name == "hr":
                texts.append((now, None))
                loose = -1
            if name in VOID:
                continue
            if name in BLOCKS:
                if name in ENDS_P and walls[-1]["p"]:
                    close(topmost(("p",)))
                if name in ("tr", "tbody", "tfoot"):
                    if rows[-1]:
                        close(rows[-1][0])
                elif wall[-1] in _ENDED[name] or any(walls[-1][x] for x in _ENDED[name]):
                    close(topmost(_ENDED[name]))
                up = stack[-1][1]
                attrs = m[3] or m[6] or ""
                words: list[str] = []
                if attrs:
                    for _, value in _ATTR.findall(attrs):
                        words += [w.lower() for w in _TOKEN.findall(value)]
                now, loose = self._block(name, up, words), -1
                texts.append((now, None))
            push(name, now)
        if at < len(source):
            say(source[at:])

    def features(self) -> np.ndarray:
        n = len(self.tags)
        own = np.zeros((n, 5))  # characters, in links, sentence ends, commas, pieces
        legal = np.zeros(n)
        for block, text in self.texts:
            if text is None:
                continue
            row = own[block]
            row[0] += len(text) - text.count(" ") if not text.isspace() else 0
            row[2] += text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))
            row[3] += text.count(",")
            row[4] += not text.isspace()
            if _LEGAL.search(text):
                legal[block] = 1
        own[:, 1] = self.links
        whole = np.concatenate([own, np.ones((n, 1)), np.array([[t == "p", t == "li", t in ("form", "button", "select", "label")] for t in self.tags], float)], axis=1)
        kids = np.zeros((n, 3))  # children, children of the same tag as the last, children's paragraphs
        index, same = np.zeros(n), np.zeros(n)
        by_tag: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            p = self.parent[i]
            index[i] = kids[p, 0]
            kids[p, 0] += 1
            kids[p, 2] += self.tags[i] == "p"
            by_tag[p, self.tags[i]] = by_tag.get((p, self.tags[i]), 0) + 1
        for i in range(1, n):
            same[i] = by_tag[self.parent[i], self.tags[i]]
        for i in range(n - 1, 0, -1):
            whole[self.parent[i]] += whole[i]
        hints = np.zeros((n, 1 + len(BAD)))
        inherited = np.zeros((n, 3 + len(BAD)))  # in article or main, in nav/aside/header/footer/form, any bad hint, by kind
        for i in range(n):
            t, p = self.tags[i], self.parent[i]
            for w in self.tokens[i]:
                hints[i, 0] += w in GOOD
                for k, words in enumerate(BAD.values()):
                    hints[i, 1 + k] += w in words
            above = inherited[p] if i else 0
            inherited[i] = above
            inherited[i, 0] = max(inherited[i, 0], t in ("article", "main"))
            inherited[i, 1] = max(inherited[i, 1], t in ("nav", "aside", "header", "footer", "form", "button", "select"))
            inherited[i, 2] = max(inherited[i, 2], hints[i, 1:].max() > 0)
            inherited[i, 3:] = np.maximum(inherited[i, 3:], hints[i, 1:])
        tag = np.zeros((n, len(TAGS)))
        for i, t in enumerate(self.tags):
            if t in _TAG_AT:
                tag[i, _TAG_AT[t]] = 1
        text, total = whole[:, 0], max(1.0, whole[0, 0])
        siblings = kids[np.maximum(self.parent, 0), 0]
        columns = [
            np.log1p(own[:, 0]), np.log1p(text), text / total, whole[:, 1] / np.maximum(1, text), own[:, 1] / np.maximum(1, own[:, 0]),
            np.log1p(whole[:, 2]), whole[:, 3] / np.maximum(1, text) * 100, text / whole[:, 5], np.log1p(whole[:, 5]), np.log1p(whole[:, 6]), np.log1p(whole[:, 7]), whole[:, 8],
            np.array(self.depth), index, index / np.maximum(1, siblings), siblings, same, kids[:, 0], kids[np.maximum(self.parent, 0), 2], np.arange(n) / n, legal,
        ]
        return np.concatenate([np.stack(columns, axis=1), hints, inherited, tag], axis=1)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The kept blocks: closed under parents, with the greatest sum of log-odds."""
        value = odds.copy()
        value[0] = 0
        for i in range(len(value) - 1, 0, -1):
            if value[i] > 0:
                value[self.parent[i]] += value[i]
        keep = np.zeros(len(value), bool)
        keep[0] = True
        for i in range(1, len(value)):
            keep[i] = keep[self.parent[i]] and value[i] > 0
        return keep

    def text(self, keep: np.ndarray) -> str:
        """Text of kept blocks: one line per run of text that no block boundary divides."""
        lines, run, last = [], [], -1
        for block, piece in self.texts:
            if block != last or piece is None:
                lines.append("".join(run))
                run, last = [], block
            if keep[block] and piece is not None:
                run.append(piece)
        lines.append("".join(run))
        clean = (_SPACE.sub(" ", html.unescape(x)).strip() for x in lines if x)
        return "\n".join(x for x in clean if x)


_TAG_AT = {t: i for i, t in enumerate(TAGS)}


class Trees:
    """Gradient boosting with logistic loss on quantile-binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        share = np.average(y, weights=weight)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        width = max(map(len, cuts)) + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            size = 1 << self.depth
            feature, limit, leaf = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(2 * size)
            at = np.ones(len(y), np.int64)
            for node in range(1, size):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                best = (1e-6, 0, 0)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]):
                    c = code[rows, f]
                    sg, sh = np.cumsum(np.bincount(c, g[rows], width))[:-1], np.cumsum(np.bincount(c, h[rows], width))[:-1]
                    ok = (sh >= self.least) & (total_h - sh >= self.least)
                    gain = np.where(ok, sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), 0)
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, b)
                if best[0] > 1e-6:
                    feature[node], limit[node] = best[1], cuts[best[1]][best[2]]
                at[rows] = 2 * node + (x[rows, feature[node]] > limit[node])
            for node in range(size, 2 * size):
                rows = at == node
                if rows.any():
                    leaf[node] = -self.rate * g[rows].sum() / (h[rows].sum() + 1)
            score += leaf[at]
            self.trees.append((feature, limit, leaf))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, limit, leaf in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (x[rows, feature[at]] > limit[at])
            out += leaf[at]
        return out


def generated_page(seed: int) -> tuple[str, set[int]]:
    """A page with a known answer: its source, and the numbers (in page order) of blocks that belong to the article.

    Blocks are numbered by the mark data-k that the generator leaves on each of them.
    """
    r = random.Random(seed)
    count, good = 0, set()
    syllable = ["ta", "re", "no", "lis", "mo", "er", "an", "ti", "o", "sen", "ka", "ü", "é", "in"]

    def words(n: int) -> str:
        return " ".join("".join(r.choices(syllable, k=r.randint(1, 4))) for _ in range(n))

    def prose(lo: int = 1, hi: int = 6) -> str:
        out = [words(r.randint(1, 16)).capitalize() + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.randint(lo, hi))]
        text = " ".join(out)
        return text.replace(" ", ", ", 1) if r.random() < 0.5 else text

    def el(tag: str, inner: str, content: bool, attrs: str = "", close: bool = True) -> str:
        nonlocal count
        mark = f' data-k="{count}"'
        if content:
            good.add(count)
        count += 1
        return f"<{tag}{mark}{attrs}>{inner() if callable(inner) else inner}" + (f"</{tag}>" if close else "")

    def cls(*names: str) -> str:
        return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if r.random() < 0.8 else ""

    def link(n: int = 2) -> str:
        return f'<a href="/{words(1)}">{words(r.randint(1, n))}</a>'

    def listing(content: bool = False) -> str:
        return el(r.choice(["ul", "ul", "ol"]), lambda: "".join(el("li", prose(1, 2) if content else link(), content, close=r.random() < 0.8) for _ in range(r.randint(2, 9))), content)

    def loose(inner: str, content: bool) -> str:
        """Text without an element of its own."""
        nonlocal count
        if content:
            good.add(count)
        count += 1
        return f"<!--k{count - 1}-->{inner}"

    def bare() -> str:
        """Furniture that no attribute gives away."""
        k = r.random()
        if k < 0.4:
            text = r.choice(["&copy; 2021 ", "Copyright 2020 ", "\u00a9 2019 "]) + words(r.randint(0, 4)) + r.choice(["", " All rights reserved."])
        elif k < 0.7:
            text = " ".join(link(1) for _ in range(r.randint(2, 7)))
        else:
            text = " ".join(words(1).capitalize() for _ in range(r.randint(1, 6)))
        return loose(text, False) if r.random() < 0.5 else el(r.choice(["div", "div", "p"]) if k < 0.4 else "div", text, False)

    def junk(kind: str) -> str:
        if kind == "nav":
            return el(r.choice(["nav", "nav", "div"]), listing, False, ' class="menu"' if r.random() < 0.6 else ' role="navigation"')
        if kind == "header":
            return el(r.choice(["header", "header", "div"]), lambda: el("p", words(r.randint(1, 5)), False) + (listing() if r.random() < 0.4 else ""), False, cls("header", "site-header", "masthead", "top-banner") or ' class="header"')
        if kind == "footer":
            return el(r.choice(["footer", "footer", "div"]), lambda: f"&copy; {words(2)} &middot; {prose(1, 3)}" + (listing() if r.random() < 0.3 else el("p", prose(1, 2), False) if r.random() < 0.4 else ""), False, cls("footer", "site-footer", "copyright") or ' class="footer"')
        if kind == "aside":
            return el(r.choice(["aside", "aside", "div"]), lambda: el("h3", words(2), False) + (listing() if r.random() < 0.6 else el("p", prose(1, 3), False)), False, cls("sidebar", "related", "widget-area", "recommended") or ' class="sidebar"')
        if kind == "ad":
            return el(r.choice(["div", "div", "section"]), prose(1, 3) if r.random() < 0.6 else lambda: el("p", prose(1, 2), False), False, r.choice([' class="ad"', ' class="ads"', ' id="ad-1"', ' class="advert"', ' class="sponsored"', ' class="promo-box"']))
        if kind == "notice":
            return el("div", prose(1, 3) if r.random() < 0.5 else lambda: el("p", prose(1, 2), False) + el("button", words(1), False), False, r.choice([' class="cookie-notice"', ' id="cookie-consent"', ' class="newsletter"', ' class="notice"', ' class="gdpr-banner"', ' role="alert"']))
        if kind == "form":
            return el("form", lambda: el("label", words(2), False) + "<input name=q>" + (el("p", prose(1, 1), False) if r.random() < 0.4 else "") + el("button", words(1), False), False)
        return el(r.choice(["section", "div", "div"]), lambda: el("h3", words(2), False) + "".join(el(r.choice(["div", "li", "p", "article"]), (lambda: el("p", prose(1, 4), False)) if r.random() < 0.5 else prose(1, 3), False, cls("comment", "reply") or ' class="comment"') for _ in range(r.randint(1, 5))), False, r.choice([' class="comments"', ' id="comments"', ' class="comment-list"', ' id="disqus_thread"']))

    def article() -> str:
        parts = [el("h1", words(r.randint(1, 9)), True)] if r.random() < 0.9 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            k = r.random()
            if k < 0.72:
                inner = prose(1, 7)
                inner = f"<b>{inner}<br>" if r.random() < 0.2 else inner.replace(" ", f" {link()} ", 1) if r.random() < 0.15 else inner
                parts.append(el("p", inner, True, close=r.random() < 0.8))
            elif k < 0.8:
                parts.append(el(r.choice(["h2", "h3"]), words(r.randint(1, 5)), True))
            elif k < 0.86:
                parts.append(listing(True))
            elif k < 0.9:
                parts.append(el("blockquote", (lambda: el("p", prose(), True)) if r.random() < 0.5 else prose(), True))
            elif k < 0.92:
                parts.append(el("pre", prose(), True))
            elif k < 0.94:
                parts.append(el("table", lambda: "".join(el("tr", lambda: "".join(el("td", words(2), True) for _ in range(3)), True) for _ in range(3)), True))
            elif k < 0.97:
                parts.append(junk(r.choice(["ad", "aside", "notice", "form"])))
            else:
                parts.append(el("div", prose(), True))
        return "".join(parts)

    def wrapped() -> str:
        kind = r.random()
        if kind < 0.08:
            return article()
        if kind < 0.12:
            return "".join(loose(prose(2, 7), True) + (el("p", prose(2, 7), True) if r.random() < 0.6 else "<hr>") for _ in range(r.randint(1, 3)))
        if kind < 0.55:
            body = lambda: el("article", article, True, cls("post", "article", "entry") if r.random() < 0.4 else "")
        elif kind < 0.7:
            body = lambda: el("main", article, True, cls("content", "main") if r.random() < 0.5 else "")
        else:
            body = lambda: el("div", article, True, r.choice([' class="content"', ' id="content"', ' class="post-body"', ' class="article-body"', ' class="entry-content"', ' id="main"', ' class="story"']))
        return el(r.choice(["div", "main", "section"]), body, True, cls("wrapper", "container", "page", "content")) if r.random() < 0.4 else body()

    def body() -> str:
        top = [junk(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.45]
        r.shuffle(top)
        mid = wrapped()
        low = [junk(k) for k in ("comments", "aside", "ad", "nav", "form", "footer") if r.random() < 0.45]
        if r.random() < 0.3:
            top.insert(0, bare())
        if r.random() < 0.3:
            low.append(bare())
        return "".join(top) + mid + "".join(low)

    # marks follow the page order only if inner parts are made after their element's mark is drawn, as el() does
    head = f'<head><meta charset="utf-8"><title>{words(4)}</title><style>p{{margin:0}}</style></head>'
    return f"<!DOCTYPE html><html>{head}" + el("body", body, True) + "</html>", good


_MARK = re.compile(r'<(?:[a-z][a-z0-9]* data-k="|!--k)(\d+)')


def training_set(pages: int = 900) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the blocks of generated pages."""
    xs, ys, ws = [], [], []
    for seed in range(pages):
        source, good = generated_page(seed)
        page = Page(source)
        marks = [int(k) for k in _MARK.findall(source)]
        blocks = [i for i, t in enumerate(page.tags) if t not in ("#page", "html", "head")]
        assert len(marks) == len(blocks), (seed, len(marks), len(blocks))
        xs.append(page.features()[blocks])
        ys += [float(k in good) for k in marks]
        ws += [1.0] * len(marks)
    return np.concatenate(xs), np.array(ys), np.array(ws)


@lru_cache(maxsize=1)
def trained() -> Trees:
    return Trees().fit(*training_set())


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    sizes = [len(p.tags) for p in pages]
    odds = trees.odds(np.concatenate([p.features() for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for p, n in zip(pages, sizes, strict=True):
        mine = odds[at : at + n]
        mine = np.where([t in LOOSE for t in p.tags], 0.01, np.where([t == "head" for t in p.tags], -9.0, mine))
        out.append(p.text(p.decode(mine)))
        at += n
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every whole page.

    A null or empty page, or one without an article, has the empty text. Text that stands directly in the page or body
    is judged as a block of its own. Repeated rows stay; null keys and urls are kept; further columns are ignored; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = main_texts(b.column(2).to_pylist(), held.value)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
