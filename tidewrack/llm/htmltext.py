"""Main text of web pages, by gradient-boosted trees over DOM nodes.

A lenient parser builds a tree of block elements; inline markup stays in the text of its block. Each node
gets features of its tag, its attribute tokens, its depth, the density of text and links in its subtree and
how it compares with its siblings. Boosted trees give each node's odds of belonging to the main text, or of
holding it. A dynamic program then picks the likeliest labelling of the tree among those in which
everything below a rejected node is rejected, so no ancestor and descendant contradict each other: a node that is rejected
pays for all nodes below it, as one that is kept does, and so the number of its children favours neither. A block is kept
if its node and all ancestors are. Elements that hold a single element and nothing else add neither to depth nor to density.

The trees are trained here, on PAGES labelled pages that a seeded generator lays out in many ways.

Edge cases: null or empty html gives an empty text; unclosed, stray or crossing tags are repaired; scripts,
styles, comments and what is in the head never are text, nor are buttons outside paragraphs and headings; ids and urls may be null or repeat, since each row is
taken by itself; a very long or deep page is one tree like any other; other columns, whatever their names, are not read; a page
with no kept block gives an empty text; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import in_slices
from tidewrack.llm.trees import Trees, boost

PAGES, SEED = 1500, 10
#: Nodes that are scored together.
SLICE = 60_000
#: Elements that begin and end a block, hold no content, or hold no text of the page.
BLOCKS = frozenset("html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend address details summary dialog hr center menu hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video textarea select option datalist button".split())
#: Elements that may stand in a head, and those of SILENT whose text never is given back.
HEADED = frozenset("title base basefont link meta script style noscript template".split())
GONE = frozenset("head script style".split())
#: Blocks in which a button is part of the text.
SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: An element of the key closes an open one of the values, up to an element of the third set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words in class, id and role attributes of what is not main text, and of what may be.
NOISE = (
    "nav navigation menu breadcrumb breadcrumbs header banner masthead footer sidebar side aside widget complementary contentinfo "
    "ad ads advert advertisement sponsor sponsored promo promotion cookie cookies consent notice alert modal popup overlay toast "
    "comment comments discussion reply disqus feedback form search login signup newsletter subscribe share social related recommended "
    "tags meta author byline pagination pager toolbar hidden skip copyright legal"
).split()
ATTRIBUTES = NOISE + (
    "article content main post entry story body text page container wrapper row col column layout prose"
).split()
OUTER = "article main section nav aside header footer form ul ol table dialog details".split()
TAGS = "html body main article section nav aside header footer div p h1 h2 h3 ul ol li table td blockquote pre figure figcaption form dl address dialog details".split()


class Node:
    __slots__ = ("attributes", "chars", "children", "depth", "form", "hidden", "inner", "label", "link", "links", "parent", "stops", "tag", "texts")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.children: list[int] = []
        self.attributes: frozenset[str] = frozenset()
        self.hidden = self.label = False
        self.chars = self.link = self.links = self.stops = self.texts = self.form = 0


class Parser(HTMLParser):
    """Block elements as a list of nodes in page order, and text blocks as (node, text)."""

    def __init__(self, endless: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.endless = endless  # silent elements without an end, by number
        self.found: set[int] = set()  # more of them
        self.starts: list[int] = []  # the numbers of `silent`
        self.inside: list[str] = []  # blocks that began in `silent`
        self.number = 0
        self.nodes = [Node("html", -1, 0)]
        self.blocks: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("html", 0)]  # block elements only
        self.inline: list[str] = []  # since the innermost block began
        self.silent: list[str] = []
        self.buffer: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            node = self.nodes[self.open[-1][1]]
            if text:
                self.blocks.append((self.open[-1][1], text))
                node.chars += len(text)
                node.texts += 1
                node.stops += sum(map(text.count, ".,;:!?"))

    def close_to(self, place: int) -> None:
        self.flush()
        del self.open[place:]
        self.inline.clear()
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"] and tag not in HEADED and tag != "head":
            self.unsilence(0)  # the end tag of a head may be left out
        if tag in SILENT:
            self.number += 1
        if self.silent:
            if tag == self.silent[-1] or (self.silent[-1] == "head" and tag in SILENT):
                self.silent.append(tag)
                self.starts.append(self.number)
            elif tag in BLOCKS and tag not in VOID:
                self.inside.append(tag)
            return
        if tag in SILENT and not (tag == "button" and self.open[-1][0] in SENTENCES):
            if (tag == "head" and len(self.nodes) > 1) or self.number in self.endless:
                return
            self.silent.append(tag)
            self.starts.append(self.number)
            return
        if tag in ("html", "body"):
            for name, place in self.open:
                if name == tag:
                    self.note(self.nodes[place], attrs)
                    return
        if tag not in BLOCKS:
            if tag in ("br", "wbr", "img"):
                self.buffer.append("" if tag == "wbr" else " ")
            elif tag not in VOID:
                self.inline.append(tag)
                if tag == "a":
                    self.linked += 1
                    self.nodes[self.open[-1][1]].links += 1
            if tag in ("input", "label"):
                self.nodes[self.open[-1][1]].form += 1
            return
        for place in range(len(self.open) - 1, 0, -1):  # a block ends an open paragraph
            if self.open[place][0] == "p":
                self.close_to(place)
                break
            if self.open[place][0] not in ("p",):
                break
        if tag in CLOSES:
            closing, edge = CLOSES[tag]
            for place in range(len(self.open) - 1, 0, -1):
                if self.open[place][0] in edge:
                    break
                if self.open[place][0] in closing:
                    self.close_to(place)
                    if tag != "tr":
                        break
        self.flush()
        if tag == "hr":
            return
        parent = self.open[-1][1]
        node = Node(tag, parent, self.nodes[parent].depth + 1)
        self.note(node, attrs)
        self.nodes[parent].children.append(len(self.nodes))
        self.open.append((tag, len(self.nodes)))
        self.nodes.append(node)
        self.inline, self.linked = [], 0

    def note(self, node: Node, attrs) -> None:
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                node.attributes |= frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value or "").lower()))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in (value or "").replace(" ", "").lower()):
                node.hidden = True
            elif name == "data-label" and value == "keep":
                node.label = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                self.unsilence(len(self.silent) - 1 - self.silent[::-1].index(tag))
                return
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
                return
            if tag not in BLOCKS or all(tag != name for name, _ in self.open[1:]):
                return
            self.lost()  # the end of a block around it
        if tag in BLOCKS:
            if tag in ("html", "body"):
                return
            for place in range(len(self.open) - 1, 0, -1):
                if self.open[place][0] == tag:
                    self.close_to(place)
                    return
            if tag == "p":
                self.flush()
        elif tag in self.inline:
            self.inline.reverse()
            self.inline.remove(tag)
            self.inline.reverse()
            if tag == "a":
                self.linked = max(0, self.linked - 1)

    def unsilence(self, place: int) -> None:
        del self.silent[place:], self.starts[place:]
        self.inside.clear()

    def lost(self) -> None:
        """The open silent elements have no end."""
        for tag, number in zip(self.silent, self.starts, strict=True):
            if tag not in GONE:
                self.found.add(number)
        self.unsilence(0)

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.unsilence(0)
        if not self.silent:
            self.buffer.append(data)
            if self.linked:
                self.nodes[self.open[-1][1]].link += len(data.strip())


def parse(html: str) -> Parser:
    """Reads the page again while it finds elements without an end: what they held is text of the page.

    A reading finds all elements without an end that are not within another, with those of their own tag inside them, so
    there are about as many readings as tags that are left open within each other."""
    endless: frozenset[int] = frozenset()
    while True:
        p = Parser(endless)
        p.feed(html)
        # An element whose end is missing at the end of the page must not hide what the parser still holds back.
        p.close()
        p.lost()
        p.flush()
        if not p.found:
            return p
        endless |= p.found


TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
#: What passes from a node to those below it: attribute words, how many of them are NOISE, and the tag.
PASSED = {t: i for i, t in enumerate([*ATTRIBUTES, "noise", "other", *(f"<{t}>" for t in OUTER)])}
NUMBERS = 22
WIDTH = NUMBERS + len(TAGS) + 2 * len(PASSED)


def features(nodes: list[Node], out: np.ndarray) -> None:
    """Fills one row for each node. Attribute tokens count for the node, and again for those below it, the less the further."""
    n = len(nodes)
    chars, link, links, stops, texts, size, form, paragraphs = (np.zeros(n) for _ in range(8))
    lone = [len(v.children) == 1 and not v.texts for v in nodes]  # a wrapper of one element
    depth = [0] * n
    for i in range(n - 1, -1, -1):
        v = nodes[i]
        chars[i] += v.chars
        link[i] += v.link
        links[i] += v.links
        stops[i] += v.stops
        texts[i] += v.texts
        form[i] += v.form + (v.tag == "form")
        size[i] += not lone[i]
        paragraphs[i] += v.tag == "p"
        if v.parent >= 0:
            for a in (chars, link, links, stops, texts, form, size, paragraphs):
                a[v.parent] += a[i]
    total = max(chars[0], 1.0)
    before = 0.0
    places, alike = [0] * n, [1.0] * n
    for v in nodes:
        tags = Counter(nodes[s].tag for s in v.children)
        for place, s in enumerate(v.children):
            places[s], alike[s] = place, tags[nodes[s].tag] / len(v.children)
    for i, v in enumerate(nodes):
        row = out[i]
        up = nodes[v.parent] if v.parent >= 0 else v
        sibs = up.children if v.parent >= 0 else [0]
        place = places[i]
        depth[i] = depth[v.parent] + (not lone[v.parent]) if v.parent >= 0 else 0
        mean = (chars[v.parent] - up.chars) / len(sibs) if v.parent >= 0 else chars[0]
        row[:NUMBERS] = (
            np.log1p(chars[i]), chars[i] / total, link[i] / (chars[i] + 1), links[i] / max(size[i], 1), chars[i] / max(size[i], 1), stops[i] / (chars[i] + 1),
            texts[i] / max(size[i], 1), np.log1p(size[i]), depth[i], len(v.children), np.log1p(v.chars), place, place / len(sibs), len(sibs),
            chars[i] / (mean + 1), alike[i], form[i], paragraphs[i], before / total,
            v.hidden, chars[v.parent] / total if v.parent >= 0 else 1.0, link[v.parent] / (chars[v.parent] + 1) if v.parent >= 0 else 0.0,
        )
        before += v.chars
        if v.tag in TAG_NUMBER:
            row[NUMBERS + TAG_NUMBER[v.tag]] = 1
        own = NUMBERS + len(TAGS)
        for t in v.attributes:
            if t in PASSED:
                row[own + PASSED[t]] = 1
                row[own + PASSED["noise" if PASSED[t] < len(NOISE) else "other"]] += 1
        if v.tag in OUTER:
            row[own + PASSED[f"<{v.tag}>"]] = 1
        if v.parent >= 0:
            tail = own + len(PASSED)
            np.maximum(out[v.parent, tail:] * (1.0 if lone[v.parent] else 0.5), out[v.parent, own:tail], out=row[tail:])


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which all below a rejected node is rejected. odds: of keeping each node."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].hidden:
            keep[i] = -np.inf
        up = nodes[i].parent
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = [False] * len(nodes)
    for i, v in enumerate(nodes):
        kept[i] = v.parent < 0 or (kept[v.parent] and bool(keep[i] > drop[i]))
    return kept


def texts(pages: list[str], trees: Trees):
    """The main text of each page."""
    at = 0
    while at < len(pages):
        parsed, n = [], 0
        while at < len(pages) and n < SLICE:
            parsed.append(parse(pages[at]))
            n += len(parsed[-1].nodes)
            at += 1
        x, first = np.zeros((n, WIDTH), np.float32), 0
        for p in parsed:
            features(p.nodes, x[first : first + len(p.nodes)])
            first += len(p.nodes)
        odds, first = trees.total(x), 0
        for p in parsed:
            kept = decode(p.nodes, odds[first : first + len(p.nodes)])
            first += len(p.nodes)
            yield "\n\n".join([t for i, t in p.blocks if kept[i]])


class Generator:
    """Labelled training pages: the nodes of the main text, and what holds them, say data-label="keep"."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int, link: float = 0.0) -> str:
        r, out = self.r, []
        for _ in range(r.randint(lo, hi)):
            w = "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
            w = w.capitalize() if r.random() < 0.12 else w
            w += r.choice([".", ",", "", "", "", "", ""])
            out.append(f"<a href='#'>{w}</a>" if r.random() < link else f"<b>{w}</b>" if r.random() < 0.03 else w)
        return " ".join(out)

    def attr(self, *names: str) -> str:
        """One of the names as a class, an id or both; or, one time in seven, nothing."""
        r = self.r
        if r.random() < 0.15 or not names:
            return ""
        name = r.choice(names)
        return f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", " " + r.choice(["x", "col", "block", "inner", "js"]), "-" + str(r.randint(1, 9))])}"'

    def element(self, tags: list[str], inside: str, attributes: str = "") -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def links(self, lo: int, hi: int) -> str:
        r = self.r
        items = [f"<a href='/{i}'>{self.words(1, 3)}</a>" for i in range(r.randint(lo, hi))]
        style = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.6 else " | ".join(items) if style < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def noise(self, kind: str) -> str:
        r, w = self.r, self.words
        if kind == "nav":
            tag = r.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{self.attr('nav', 'menu', 'navigation', 'main-menu', 'breadcrumb', 'topnav')}>{self.links(3, 12)}</{tag}>"
        if kind == "header":
            tag = r.choice(["header", "header", "div"])
            inside = self.element(["h1", "div", "p", "h2"], w(1, 4)) + (self.noise("nav") if r.random() < 0.5 else "") + (f"<p>{w(3, 9)}</p>" if r.random() < 0.5 else "")
            return f"<{tag}{self.attr('header', 'banner', 'masthead', 'site-header', 'top')}>{inside}</{tag}>"
        if kind == "footer":
            tag = r.choice(["footer", "footer", "div"])
            return f"<{tag}{self.attr('footer', 'site-footer', 'contentinfo', 'legal', 'copyright')}>{r.choice(['&copy; ', '', 'Copyright '])}{w(3, 14, 0.2)}{self.links(2, 6) if r.random() < 0.5 else ''}{'<p>' + w(5, 25) + '</p>' if r.random() < 0.4 else ''}</{tag}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            body = "".join(self.element(["h3", "h4", "h2"], w(1, 4)) + r.choice([self.links(3, 8), f"<p>{w(6, 40, 0.1)}</p>"]) for _ in range(r.randint(1, 3)))
            names = ("sidebar", "side", "widget", "aside", "related", "recommended", "complementary")
            named = self.attr(*names) or (f' class="{r.choice(names)}"' if tag != "aside" else "")  # else nothing tells it from a section
            return f"<{tag}{named}>{body}</{tag}>"
        if kind == "ad":
            name = r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "banner ad"])
            return self.element(["div", "div", "section", "aside"], r.choice(["", "<p>"]) + w(3, 40, 0.1), f' {r.choice(["class", "id"])}="{name}"')
        if kind == "notice":
            return f"<div {r.choice(['class', 'id', 'role'])}=\"{r.choice(['cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'modal', 'popup', 'cookie-banner', 'toast'])}\">{r.choice(['', '<p>'])}{w(6, 40, 0.05)}<button>{w(1, 2)}</button></div>"
        if kind == "form":
            fields = "".join(f"<label>{w(1, 3)}</label><input name=a>" for _ in range(r.randint(1, 4)))
            inner = f"<form{self.attr('search', 'newsletter', 'login', 'subscribe', 'signup', 'form')}><p>{w(2, 14)}</p>{fields}<button>{w(1, 2)}</button></form>"
            return inner if r.random() < 0.6 else f"<div{self.attr('newsletter', 'subscribe', 'search')}>{inner}</div>"
        if kind == "share":
            return f"<div{self.attr('share', 'social', 'tags', 'meta', 'related')}>{self.links(2, 6)}</div>"
        rows = "".join(f"<{t}{self.attr('comment', 'reply', 'comment-body')}>" + (self.element(["div", "h4", "p"], w(1, 4), self.attr("author", "meta")) if r.random() < 0.6 else "") + f"<p>{w(4, 70)}</p></{t}>" for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 8)))
        rows = f"<ol>{rows}</ol>" if rows.startswith("<li") else rows
        head = f"<h3>{w(1, 3)}</h3>" if r.random() < 0.7 else ""
        tag = r.choice(["section", "div", "div"])
        return f"<{tag} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'comment-list', 'discussion', 'comments-area', 'feedback', 'disqus thread'])}\">{head}{rows}{self.noise('form') if r.random() < 0.4 else ''}</{tag}>"

    def wrapped(self, inside: str, names: tuple[str, ...] = ()) -> str:
        """Wrappers around one element: none, a few, or one time in thirty many."""
        r, k = self.r, ' data-label="keep"'
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2]) if r.random() < 0.97 else r.randint(5, 60)):
            tag = r.choice(["div", "div", "section"])
            inside = f"<{tag}{k}{self.attr(*names)}>{inside}</{tag}>"
        return inside

    def part(self) -> str:
        """A section of an article: an unnamed or plainly named block of a heading, paragraphs, lists."""
        r, w, k = self.r, self.words, ' data-label="keep"'
        if r.random() < 0.3:
            return f"<div{k}>{w(1, 80, r.choice([0, 0, 0.05]))}</div>"
        inside = f"<{t}{k}>{w(1, 8)}</{t}>" if r.random() < 0.6 and (t := r.choice(["h2", "h3", "h4"])) else ""
        for _ in range(r.choice([1, 1, 2, 2, 3, 6])):
            inside += f"<p{k}>{w(1, r.choice([4, 12, 60, 140]), r.choice([0, 0, 0.04]))}</p>" if r.random() < 0.8 else f"<ul{k}>" + "".join(f"<li{k}>{w(1, 20)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        tag = r.choice(["section", "section", "div", "div", "div"])
        names = self.attr("section", "chapter", "text", "block", "part", "content", "row", "col") if r.random() < 0.4 else ""
        return self.wrapped(f"<{tag}{k}{names}>{inside}</{tag}>", ("row", "col", "block"))

    def article(self) -> str:
        r, w, k = self.r, self.words, ' data-label="keep"'
        parts = [f"<h1{k}>{w(2, 12)}</h1>"] if r.random() < 0.8 else []
        if parts and r.random() < 0.25:
            parts = [f"<header{k}>{parts[0]}</header>"]
        plain = r.random() < 0.35  # nothing but paragraphs
        split = not plain and r.random() < 0.2  # nothing but sections
        for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8, 12, 20]) if r.random() < 0.98 else r.randint(80, 300)):
            kind = 0.0 if plain else r.random()
            if split or 0.56 < kind < 0.66:
                parts.append(self.part())
            elif kind < 0.66:
                parts.append(f"<p{k}>{r.choice(['', '<b>', ''])}{w(1, r.choice([2, 4, 12, 60, 140, 300]), r.choice([0, 0, 0.04]))}{r.choice(['</p>', '</p>', '<br>', ''])}")
            elif kind < 0.74:
                parts.append(f"<{t}{k}>{w(1, 8)}</{t}>" if (t := r.choice(["h2", "h3", "h4"])) else "")
            elif kind < 0.84:
                t = r.choice(["ul", "ol"])
                whole = r.random() < 0.35  # items that are links
                items = [f"<a href='/x'>{w(1, r.choice([3, 14]))}</a>" if whole else w(1, 25, r.choice([0, 0, 0.1])) for _ in range(r.randint(1, 8))]
                parts.append(f"<{t}{k}>" + "".join(f"<li{k}>{x}{r.choice(['</li>', ''])}" for x in items) + f"</{t}>")
            elif kind < 0.89:
                parts.append(f"<blockquote{k}><p{k}>{w(5, 60)}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<table{k}><tbody{k}>" + "".join(f"<tr{k}>" + "".join(f"<td{k}>{w(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))) + "</tbody></table>")
            elif kind < 0.96:
                parts.append(f"<figure{k}><img src=x><figcaption{k}>{w(2, 16)}</figcaption></figure>")
            else:
                parts.append(f"<pre{k}>{w(3, 40)}</pre>")
            if r.random() < 0.07 and not plain:
                parts.append(self.noise(r.choice(["ad", "ad", "share", "form", "notice", "side"])))
        return "".join(parts)

    def page(self) -> str:
        r, k = self.r, ' data-label="keep"'
        body = self.article()
        body = self.wrapped(body, ("content", "text", "entry-content", "body", "prose", "article-body"))
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        names = self.attr("content", "article", "post", "entry", "story", "main", "page-content") if tag != "article" or r.random() < 0.4 else ""
        if tag in ("div", "section") and not names:
            names = f' class="{r.choice(["content", "post", "entry", "main", "article", "text"])}"'
        after = self.noise("comments") if r.random() < 0.3 else ""
        inside = r.random() < 0.3
        body = f"<{tag}{k}{names}>{body}{after if inside else ''}</{tag}>{'' if inside else after}"
        if r.random() < 0.3 and tag != "main":
            body = f"<main{k}>{body}{self.noise('side') if r.random() < 0.3 else ''}</main>"
        tops = [self.noise(x) for x in r.choice([["nav", "ad"], ["nav"], ["header"], ["header", "nav"], ["nav", "ad"], ["notice", "header"], ["header", "nav", "ad"], ["nav", "notice", "form"], []])]
        ends = [self.noise(x) for x in r.choice([["footer"], ["footer"], ["side", "footer"], ["share", "footer"], ["ad", "footer"], ["side", "form", "footer"], ["footer", "notice"], []])]
        if r.random() < 0.06:  # a page without a main text
            body = "" if tops or ends else self.noise("nav")
        body = "".join(tops) + body + "".join(ends)
        body = self.wrapped(body, ("wrapper", "container", "page", "row", "layout", "site"))
        return f"<!DOCTYPE html><html{k}><head><title>{self.words(2, 9)}</title></head><body{k}>{body}{r.choice(['</body></html>', '</body></html>', ''])}"


@lru_cache(maxsize=1)
def train(pages: int = PAGES, seed: int = SEED) -> Trees:
    made, rows, labels = Generator(seed), [], []
    for _ in range(pages):
        nodes = parse(made.page()).nodes
        nodes[0].label = True
        x = np.zeros((len(nodes), WIDTH), np.float32)
        features(nodes, x)
        rows.append(x[1:])
        labels += [v.label for v in nodes[1:]]
    return boost(np.concatenate(rows), np.array(labels, float))


def extract(df: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html)."""
    shared = df.sparkSession.sparkContext.broadcast(trees or train())

    def run(batches):
        for batch in batches:
            found = list(texts([x.as_py().decode("utf-8", "replace") for x in batch.column(2)], shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).transform(in_slices, run, "page_id long, url string, text string, n_chars long")


#: The same rows for the driver's pages, whose main text all stands between <article> and </article>, a block in each p or heading.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(body, '<br>', ' '), '</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote)(?: [^>]*)?>'), lambda x: trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
