"""Main text of web pages by a tree-structured graphical model over the DOM.

A forgiving parser builds the tree of block elements; each run of text in a block is a
leaf. A node is content, boilerplate, or mixed (a wrapper of both). Node potentials are
linear in features of the tag, the words of class, id and role, text length and link
density; parent-child potentials connect DOM nodes. Sum-product messages go upward and
downward once, which is exact on a tree, and give each leaf its content marginal. Leaves
of at least one half are the text.

Potentials are trained in numpy from labelled pages. These are composed here, by
`labelled_pages`, with common layouts, names and nestings, and carry their labels as
attributes; no page of the table is used.

Blocks are joined by an empty line, in page order. Inside a block character references
are decoded and white space becomes one space. Scripts, styles, comments, the title and
elements that are no running text are left out; other text in a head, which ends it in
HTML, is text. Raw-text elements without an end tag run to the end of the page; of other
elements left out, the tag alone is then. Nothing is dropped or capped otherwise.

Null and empty pages, and pages without content, give the empty text. Pages are
independent, so ties, repeated rows and empty tables need nothing more. Columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed sets of element names.
#: Raw text up to the end tag, or else to the end of the page.
RAW = "script style noscript iframe title"
#: Left out together with what is in them, if they end; else the tag alone is.
SKIPPED = frozenset("template svg math object canvas audio video select option datalist".split())
BLOCK = frozenset("html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption address details summary dialog hr center menu search button label textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - frozenset("button label html body".split())
#: An element that ends an open one of these, up to a boundary.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

OPEN = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
#: What stands in a tag behind its name; a ">" in quotes does not end it.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW.split()}
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop|data-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

BOILERPLATE, CONTENT, MIXED = 0, 1, 2
STATES = 3


@dataclass
class Node:
    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)  # of a leaf
    text: str = ""
    size: int = 0  # code points below
    linked: int = 0  # of these, in links
    count: int = 0  # leaves below


@dataclass
class Token:
    whole: str
    tag: str = ""  # lower case; empty for text, comments and raw-text elements
    closing: bool = False
    attributes: str = ""


def tag_ends(page: str) -> Callable[[int], int]:
    """Where the tag ends whose name ends at a place, or -1.

    The usual case is one match. The first tag without an end gives a table over all
    quotes and ends of tags, filled from behind, that answers for all later ones, so
    unclosed quotes don't make a scan to the end of the page for each tag.
    """
    places: list[int] = []
    ends: list[int] = []

    def fill() -> None:
        places.extend(m.start() for m in re.finditer("[>\"']", page))
        ends.extend([-1] * (len(places) + 1))
        following: dict[str, int] = {}
        for k in range(len(places) - 1, -1, -1):
            c = page[places[k]]
            if c == ">":
                ends[k] = places[k] + 1
                continue
            if c in following:
                ends[k] = ends[following[c] + 1]
            following[c] = k

    def end(at: int) -> int:
        if not ends:
            if m := REST.match(page, at):
                return m.end()
            fill()
        return ends[bisect_left(places, at)]

    return end


def tokens_of(page: str) -> list[Token]:
    """Tags, comments, raw-text elements and text, in time that follows the page's length."""
    out, at, n, end_of = [], 0, len(page), tag_ends(page)
    last = page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start != at:
            out.append(Token(page[at : start if start >= 0 else n]))
            if start < 0:
                break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else n
            out.append(Token(page[start:at]))
            continue
        m = OPEN.match(page, start)
        if m and (stop := end_of(m.end())) >= 0:
            tag, at = m[2].lower(), stop
            if tag in RAW_END and not m[1] and page[m.end()] in " \t\n\r\f/>":
                ended = RAW_END[tag].search(page, stop)
                at = ended.end() if ended else n
                out.append(Token(page[start:at]))
            else:
                out.append(Token(page[start:stop], tag, bool(m[1]), page[m.end() : stop - 1]))
            continue
        at = start + 1
        if page[at : at + 1] in ("!", "?", "/") and at < last:
            at = page.find(">", at + 1) + 1 or at
        out.append(Token(page[start:at]))
    return out


def _ends(tokens: list[Token]) -> dict[int, int]:
    """For the places of tags in SKIPPED that are ended: the place of the end tag."""
    ends, opened = {}, {}
    for i, m in enumerate(tokens):
        if (tag := m.tag) in SKIPPED:
            if not m.closing:
                if tag in ("svg", "math") and m.attributes.endswith("/"):
                    ends[i] = i
                else:
                    opened.setdefault(tag, []).append(i)
            elif opened.get(tag):
                ends[opened[tag].pop()] = i
    return ends


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; the first is the root."""
    nodes = [Node("#root", -1)]
    stack, leaf, links = [0], -1, 0

    opened: Counter = Counter()  # tags on the stack, so that it is searched only for what is there

    def close(upto: int) -> None:
        nonlocal leaf
        opened.subtract(nodes[i].tag for i in stack[upto:])
        del stack[upto:]
        leaf = -1

    skipped = -1
    tokens = tokens_of(page)
    ends = _ends(tokens)
    for place, m in enumerate(tokens):
        if place <= skipped:
            continue
        tag = m.tag
        if not tag:
            s = m.whole
            if s[0] != "<" or s == "<":
                if leaf < 0:
                    if s.isspace():
                        continue
                    leaf = len(nodes)
                    nodes.append(Node("#text", stack[-1]))
                n = nodes[leaf]
                n.parts.append(s)
                if links:
                    n.linked += len(s)
            continue
        skipped = ends.get(place, skipped)
        if tag not in BLOCK:
            if tag == "a":
                links = 0 if m.closing else 1
            elif tag in ("br", "img", "input") and leaf >= 0:
                nodes[leaf].parts.append(" ")
            continue
        if m.closing:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if nodes[stack[i]].tag == tag:
                    close(i)
                    break
            leaf = -1
            links = 0
            continue
        links = 0
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == "p":
                    close(i)
                    break
                if nodes[stack[i]].tag in ("button", "td", "th", "li", "div", "article", "section"):
                    break
        if tag in ENDS:
            ended, bound = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ended) else ():
                if nodes[stack[i]].tag in bound:
                    break
                if nodes[stack[i]].tag in ended:
                    close(i)
                    break
        leaf = -1
        if tag in ("html", "body") and any(n.tag == tag for n in nodes[:8]):
            continue
        attributes = {a[1].lower(): next((v for v in a.groups()[1:] if v is not None), "") for a in ATTRIBUTE.finditer(m.attributes)} if m.attributes else {}
        nodes.append(Node(tag, stack[-1], attributes))
        if tag not in VOID:
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    for n in nodes:
        if n.parts:
            raw = "".join(n.parts)
            n.text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            n.size, n.count, n.linked = len(n.text), 1, min(n.linked, len(n.text))
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        p.size, p.linked, p.count = p.size + n.size, p.linked + n.linked, p.count + n.count
    return nodes


def features(n: Node, parent: Node | None) -> tuple[str, ...]:
    """Names of what holds for a node; all are of one kind, on or off."""
    share = 0 if not n.size else min(4, 1 + 4 * n.linked // n.size) if n.linked else 0
    if n.tag == "#text":
        t = n.text
        out = [f"leaf:{parent.tag}", f"leaf-size:{min(6, n.size.bit_length() // 2)}", f"leaf-links:{share}"]
        if t[-1:] in ".!?\"':;)":
            out.append("leaf-ends")
        if "©" in t[:40]:
            out.append("leaf-copyright")
        return tuple(out)
    out = [f"tag:{n.tag}", f"size:{min(6, n.size.bit_length() // 2)}", f"links:{share}"]
    a = n.attributes
    for key in ("class", "id", "role", "itemprop"):
        if a.get(key):
            out += [f"name:{w.lower()}" for w in NAME.findall(a[key])]
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        out.append("hidden")
    return tuple(out)


@dataclass
class Model:
    unary: dict[str, tuple[float, float, float]]
    edge: list[list[float]]  # log potential by states of parent and child, for elements
    leaf_edge: list[list[float]]  # for leaves


def _sum_exp(a: float, b: float, c: float) -> float:
    m = a if a > b else b
    m = m if m > c else c
    return m + math.log(math.exp(a - m) + math.exp(b - m) + math.exp(c - m))


def potentials(nodes: list[Node], model: Model, cache: dict | None = None) -> list[tuple[float, float, float]]:
    out = []
    cache = {} if cache is None else cache
    if len(cache) > 50_000:
        cache.clear()
    for n in nodes:
        f = features(n, nodes[n.parent] if n.parent >= 0 else None)
        u = cache.get(f)
        if u is None:
            known = [model.unary[x] for x in f if x in model.unary]
            u = tuple(sum(x[s] for x in known) - (1e3 if f[0][:5] == "leaf:" and s == MIXED else 0) for s in range(STATES))
            cache[f] = u
        out.append(u)
    return out


def marginals(nodes: list[Node], model: Model, cache: dict | None = None) -> list[float]:
    """Content marginals by one upward and one downward pass of sum-product."""
    unary = potentials(nodes, model, cache)
    up = [list(u) for u in unary]  # a node's potential times its children's messages
    message: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        e = model.leaf_edge if nodes[i].tag == "#text" else model.edge
        b0, b1, b2 = up[i]
        m = [_sum_exp(r[0] + b0, r[1] + b1, r[2] + b2) for r in e]
        message[i] = m
        p = up[nodes[i].parent]
        p[0] += m[0]
        p[1] += m[1]
        p[2] += m[2]
    belief = [up[0]] + [None] * (len(nodes) - 1)
    out = [0.0] * len(nodes)
    for i in range(1, len(nodes)):
        e = model.leaf_edge if nodes[i].tag == "#text" else model.edge
        p, m = belief[nodes[i].parent], message[i]
        c0, c1, c2 = p[0] - m[0], p[1] - m[1], p[2] - m[2]
        own = up[i]
        b = [own[s] + _sum_exp(e[0][s] + c0, e[1][s] + c1, e[2][s] + c2) for s in range(STATES)]
        z = _sum_exp(*b)
        belief[i] = [x - z for x in b]
        out[i] = math.exp(belief[i][CONTENT])
    return out


def extract(page: str, model: Model, cache: dict | None = None) -> str:
    nodes = parse(page)
    p = marginals(nodes, model, cache)
    return "\n\n".join(n.text for n, x in zip(nodes, p, strict=True) if n.tag == "#text" and n.text and x >= 0.5)


# Labelled pages. Fixed lists: common names of the parts of a page.
PARTS = {
    "nav": (("nav", ""), ("div", "navbar"), ("div", "main-menu"), ("ul", "nav-links"), ("div", "breadcrumbs"), ("nav", "site-navigation")),
    "header": (("header", ""), ("div", "site-header"), ("div", "masthead"), ("header", "page-header banner")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright")),
    "side": (("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related-posts"), ("section", "recommended"), ("div", "popular")),
    "ad": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement sponsored"), ("div", "promo"), ("aside", "ad-slot"), ("div", "banner-ad")),
    "notice": (("div", "cookie-notice"), ("div", "cookie-consent"), ("div", "notice"), ("div", "alert"), ("div", "gdpr-banner"), ("div", "paywall subscribe"), ("dialog", "consent"), ("div", "popup modal newsletter")),
    "form": (("form", ""), ("form", "search-form"), ("div", "login"), ("div", "newsletter signup"), ("form", "subscribe")),
    "comments": (("div", "comments"), ("section", "comments-area"), ("ol", "comment-list"), ("div", "disqus"), ("section", "responses"), ("div", "user-comment reply")),
    "share": (("div", "share"), ("div", "social-links"), ("ul", "tags"), ("div", "meta byline-tools")),
}
ARTICLE = (("article", ""), ("main", ""), ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("div", "story content"), ("section", "article"), ("article", "post"))
WORDS = "alder brook cinder dune ember fallow grove hollow inlet juniper kestrel larch meadow nettle orchard pebble quarry ripple sorrel thicket umber valley willow yarrow".split()


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Composed pages whose elements carry data-label: 0 boilerplate, 1 content."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join(r.choice(WORDS) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        s = words(1, 18).capitalize()
        return s + r.choice((".", ".", ".", ",", "!", "?", ""))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{r.randint(0, 99)}">{words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def part(kind: str) -> str:
        tag, name = r.choice(PARTS[kind])
        text = " ".join(sentence() for _ in range(r.randint(1, 6)))
        body = {
            "nav": lambda: links(r.randint(1, 12)),
            "header": lambda: r.choice((f"<a href='/'>{words(1, 3)}</a>", f"<h2>{words(1, 4)}</h2>", f"<p>{text}</p>", "")) + r.choice((links(4), part("form") if r.random() < 0.3 else "", "")),
            "footer": lambda: r.choice((f"&copy; {words(1, 4)} &middot; {text}", f"<p>&copy; {words(2, 6)}</p>", links(5), f"<p>{text}</p>")),
            "side": lambda: f"<h3>{words(1, 4)}</h3>" + r.choice((links(5), f"<p>{text}</p>", f"<p>{text}</p><p>{text}</p>")),
            "ad": lambda: r.choice((text, f"<p>{text}</p>", f"<a href='/x'>{words(2, 8)}</a>")),
            "notice": lambda: r.choice((f"<p>{text}</p><button>{words(1, 2)}</button>", text, f"{text} <a href='/p'>{words(1, 3)}</a>")),
            "form": lambda: f"<label>{words(1, 3)}</label><input type=text><button>{words(1, 2)}</button>" + r.choice(("", f"<p>{text}</p>")),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" * r.randint(0, 1) + "".join(f"<{t} class='comment'><p>{sentence()} {sentence()}</p></{t}>" for t in [r.choice(("div", "li", "article"))] for _ in range(r.randint(1, 5))),
            "share": lambda: links(r.randint(2, 6)),
        }[kind]()
        name = f' {r.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{name} data-label="0">{body}</{tag}>'

    def text_block() -> str:
        body = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8))))
        if r.random() < 0.25:
            w = words(1, 3)
            body = body + f" <{t}>{w}</{t}>." if (t := r.choice(("b", "em", "a href='/y'", "code"))) != "a href='/y'" else body + f" <a href='/y'>{w}</a>."
        kind = r.random()
        if kind < 0.75:
            return f"<p>{body}</p>"
        if kind < 0.8:
            return f"<h2>{words(1, 6)}</h2>"
        if kind < 0.85:
            return f"<blockquote><p>{body}</p></blockquote>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.95:
            return f"<div>{body}</div>"
        if kind < 0.97:
            return f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
        return f"<figure><figcaption>{sentence()}</figcaption></figure>" if kind < 0.985 else f"<pre>{body}</pre>"

    pages = []
    for _ in range(count):
        tag, name = r.choice(ARTICLE)
        own = [f"<h1>{words(1, 9)}</h1>"] * (r.random() < 0.8) + [text_block() for _ in range(r.randint(1, 14))]
        for kind in ("ad", "share", "side", "notice", "form", "comments"):
            if r.random() < 0.3:
                own.insert(r.randint(1, len(own)), part(kind))
        name = f' class="{name}"' if name else ""
        article = f'<{tag}{name} data-label="1">{"".join(own)}</{tag}>'
        before = [part(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        behind = [part(k) for k in ("side", "comments", "ad", "share", "form", "notice", "footer") if r.random() < 0.5]
        r.shuffle(before)
        page = [*before, article, *behind]
        if r.random() < 0.4:
            page = [f'<div class="{r.choice(("container", "page", "wrapper", "row", "layout", "site"))}">{"".join(page)}</div>']
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(page)}</body></html>")
    return pages


def labels(nodes: list[Node]) -> list[int]:
    """A node's state: its nearest label upward, or mixed if it has none or holds another."""
    own = [MIXED] * len(nodes)
    for i, n in enumerate(nodes):
        given = n.attributes.get("data-label")
        own[i] = int(given) if given else own[n.parent] if n.parent >= 0 else MIXED
    out = list(own)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        if out[p] != out[i] and own[p] == MIXED:
            out[p] = MIXED
    return out


def train(pages: list[str] | None = None, rounds: int = 400, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Node potentials by softmax regression, parent-child potentials by smoothed counts."""
    x: list[tuple[str, ...]] = []
    y: list[int] = []
    pairs = np.ones((2, STATES, STATES))
    for page in pages or labelled_pages():
        nodes = parse(page)
        own = labels(nodes)
        for n, s in zip(nodes, own, strict=True):
            if n.tag == "#root":
                continue
            x.append(features(n, nodes[n.parent]))
            y.append(s)
            pairs[int(n.tag == "#text"), own[n.parent], s] += 1
    names = {f: i for i, f in enumerate(dict.fromkeys(f for row in x for f in row))}
    rows = np.repeat(np.arange(len(x)), [len(f) for f in x])
    cols = np.array([names[f] for row in x for f in row])
    target, w = np.eye(STATES)[y], np.zeros((len(names), STATES))
    seen = np.full_like(w, 1e-8)
    for _ in range(rounds):
        z = np.stack([np.bincount(rows, w[cols, s], len(x)) for s in range(STATES)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = np.stack([np.bincount(cols, (p - target)[rows, s], len(names)) for s in range(STATES)], axis=1) / len(x) + l2 * w / STATES
        seen += g**2
        w -= rate * g / np.sqrt(seen)
    prior = np.log(np.bincount(y, minlength=STATES) / len(y))
    logs = np.log(pairs / pairs.sum(axis=2, keepdims=True)) - prior  # the prior is in the node potentials already
    return Model({f: tuple(w[i].tolist()) for f, i in names.items()}, logs[0].tolist(), logs[1].tolist())


SCHEMA = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """A row per page with its main text."""
    m = model or train()
    sent = pages.sparkSession.sparkContext.broadcast((m.unary, m.edge, m.leaf_edge))  # plain data: executors need no copy of this module

    def batch(rows: dict, model: Model, cache: dict) -> dict:
        texts = [extract(h or "", model, cache) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(read, batch, SCHEMA, lambda: {"model": Model(*sent.value), "cache": {}})
