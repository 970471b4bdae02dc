"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block-level element is a node that is content or not.  A node's potential is logistic in features of its tag, its
class, id and role words, its text and its links; parent-child potentials tie a node's label to its parent's.  One upward
and one downward pass of sum-product messages give each node's marginal; the text of nodes whose marginal is over one
half is kept.  Potentials are trained here on labelled pages from a seeded page writer that mixes common page layouts.

Contents of script, style, form controls (buttons too), noscript, object, svg, math and head are never text.  Character
references are decoded once within each piece of text between tags, white space inside a block becomes one space, blocks
are joined in page order by a blank line, and nothing else is changed or cut.  Reading a page takes time in proportion to
its length, whatever its markup.

Cases: a null or empty page gives an empty text; in broken markup a quote opens a value only behind "=" and if it is closed
later, and a tag or comment that never ends takes the rest of the page; a page without any tag is one block; repeated rows
are treated alike; null ids and urls are kept.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import map_batches

TRAINING_PAGES, STEPS = 400, 300
# Fixed tag sets of HTML.
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hgroup search dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object select button canvas math noframes xmp".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "nav", "aside", "footer", "header", "form"))
P_SCOPES = SCOPES | {"li", "td", "th", "blockquote"}
HINTS = {
    "aside": frozenset("nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent notice notices gdpr newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs pagination pager widget widgets toolbar popup modal skip login search masthead topbar bottom copyright legal disclaimer tags meta byline contentinfo complementary teaser outbrain taboola alert".split()),
    "talk": frozenset("comment comments commentlist reply replies respond discussion disqus reviews thread".split()),
    "text": frozenset("article content post entry main story body text articlebody maincontent prose".split()),
}
_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_PLAIN = re.compile(r"[^>\"']*+")
_COMMENT_END = re.compile(r"--!?>|(?<=<!--)-?>")
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


class Page:
    """Block-level nodes in page order (parents first) and the text blocks with their owners."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["#page"], [-1], [""]
        self.blocks: list[tuple[int, str]] = []
        self.linked = [0]
        stack, parts, in_link, at = [0], [], 0, 0
        open_at: dict[str, list[int]] = defaultdict(list)  # places of each tag's open elements in the stack
        end, has_head_end = len(source), True
        unclosed: set[str] = set()  # quotes of which none follows any more

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1], text))
                parts.clear()

        def pop_to(names: tuple[str, ...], scopes: frozenset[str] = frozenset()) -> None:
            """Close the innermost open element of these names, unless one of the scopes is open inside it."""
            i = max((open_at[n][-1] for n in names if open_at[n]), default=0)
            if i and (not scopes or i >= max((open_at[n][-1] for n in scopes if open_at[n]), default=0)):
                flush()
                for node in reversed(stack[i:]):
                    open_at[self.tag[node]].pop()
                del stack[i:]

        def add(piece: str) -> None:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                self.linked[stack[-1]] += len(piece.strip())

        def tag_end(start: int) -> int:
            """Where the tag's ">" stands; the page's end if it has none."""
            i = start
            while True:
                i = _PLAIN.match(source, i).end()
                if i >= end or source[i] == ">":
                    return i
                quote, i = source[i], i + 1
                if quote not in unclosed:
                    before = i - 2
                    while before > start and source[before].isspace():
                        before -= 1
                    if source[before] == "=":
                        close = source.find(quote, i)
                        if close < 0:
                            unclosed.add(quote)
                        else:
                            i = close + 1

        while at < end:
            m = _OPEN.search(source, at)
            if not m:
                add(source[at:])
                break
            if m.start() > at:
                add(source[at : m.start()])
            if m[1]:
                close = _COMMENT_END.search(source, m.end())
                at = close.end() if close else end
                continue
            if not m[3]:
                at = source.find(">", m.end()) + 1 or end
                continue
            name, stop = m[3].lower(), tag_end(m.end())
            attrs, at = source[m.end() : stop], stop + 1
            if m[2]:
                if name == "a":
                    in_link = max(0, in_link - 1)
                elif name in BLOCK:
                    pop_to((name,))
                continue
            if name in RAW:
                close = _RAW_END[name].search(source, at)
                at = source.find(">", close.end()) + 1 if close else end
                at = at or end
                parts.append(" ")
            elif name == "head":
                found = _HEAD_END.search(source, at) if has_head_end else None
                has_head_end = found is not None
                at = at if not found else found.end() if found[0][1] == "/" else found.start()
                if found:
                    flush()
            elif name == "a":
                in_link = 1
            elif name == "br":
                parts.append(" ")
            elif name in BLOCK:
                flush()
                in_link = 0
                if name in CLOSES:
                    pop_to(CLOSES[name], SCOPES if name in ("li", "dt", "dd") else frozenset(("table",)))
                if open_at["p"]:
                    pop_to(("p",), P_SCOPES)
                self.tag.append(name)
                self.parent.append(stack[-1])
                self.attrs.append(attrs)
                self.linked.append(0)
                open_at[name].append(len(stack))
                stack.append(len(self.tag) - 1)
        flush()


#: Names of the node features; each is 0 or 1.
TAGS = ("article", "main", "section", "div", "p", "heading", "list", "li", "table", "quote", "header", "footer", "nav", "aside", "form", "figure", "root", "other")
_GROUP = {t: t for t in TAGS} | {f"h{i}": "heading" for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl"), "list") | dict.fromkeys(("dt", "dd"), "li") | dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th"), "table") | dict.fromkeys(("blockquote", "pre"), "quote") | {"figcaption": "figure", "fieldset": "form", "search": "form", "dialog": "aside", "html": "root", "body": "root", "#page": "root"}
FEATURES = (*TAGS, "says_aside", "says_talk", "says_text", "hidden", "no_text", "short", "medium", "long", "some_links", "mostly_links", "sentences", "header_in_article", "in_article", "bias")
_INDEX = {f: i for i, f in enumerate(FEATURES)}


def node_features(page: Page) -> list[list[int]]:
    """Indices of the features that are on, for each node."""
    n = len(page.tag)
    size, linked, stops = [0] * n, list(page.linked), [0] * n
    for owner, text in page.blocks:
        size[owner] += len(text)
        stops[owner] += text.count(".") + text.count("!") + text.count("?")
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
    out, inside = [], [False] * n
    for i in range(n):
        on = [_INDEX[_GROUP.get(page.tag[i], "other")], _INDEX["bias"]]
        if page.tag[i] == "nav":
            on.append(_INDEX["says_aside"])
        inside[i] = i > 0 and (inside[page.parent[i]] or page.tag[page.parent[i]] in ("article", "main"))
        if inside[i]:
            on.append(_INDEX["in_article"])
            if page.tag[i] == "header":
                on.append(_INDEX["header_in_article"])
        if page.attrs[i]:
            words = {w.lower() for m in _ATTR.finditer(page.attrs[i]) for w in _PART.findall(m[1] or m[2] or m[3] or "")}
            on += [_INDEX[f"says_{k}"] for k, known in HINTS.items() if words & known and _INDEX[f"says_{k}"] not in on]
            if _HIDDEN.search(page.attrs[i]):
                on.append(_INDEX["hidden"])
        s = size[i]
        on.append(_INDEX["no_text" if not s else "short" if s < 40 else "medium" if s < 200 else "long"])
        if s and linked[i] > 0.1 * s:
            on.append(_INDEX["mostly_links" if linked[i] > 0.5 * s else "some_links"])
        if stops[i] and s >= 30 * stops[i] - 20:
            on.append(_INDEX["sentences"])
        out.append(on)
    return out


class TreeModel:
    """Node weights and parent-child potentials, with sum-product inference."""

    def __init__(self, weights: list[float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def marginals(self, parent: list[int], features: list[list[int]]) -> list[float]:
        """Probability that each node is content; parents come before children."""
        n, w = len(parent), self.weights
        (p00, p01), (p10, p11) = self.pair
        own = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[k] for k in on))))) for on in features]
        up0, up1 = [1 - p for p in own], own[:]  # own potential times the messages of the children
        msg0, msg1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            s = m0 + m1
            msg0[i], msg1[i] = m0 / s, m1 / s
            p = parent[i]
            a, b = up0[p] * msg0[i], up1[p] * msg1[i]
            s = a + b or 1e-300
            up0[p], up1[p] = a / s, b / s
        out = [0.0] * n
        belief0, belief1 = up0[:], up1[:]
        for i in range(n):
            if i:
                p = parent[i]
                a, b = belief0[p] / msg0[i], belief1[p] / msg1[i]
                d0, d1 = p00 * a + p10 * b, p01 * a + p11 * b
                a, b = up0[i] * d0, up1[i] * d1
                s = a + b or 1e-300
                belief0[i], belief1[i] = a / s, b / s
            out[i] = belief1[i]
        return out


def training_page(r: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of its content blocks."""
    pool = ("the", "an", "er", "tion", "ing", "ou", "ha", "re", "st", "la", "der", "que", "los", "and", "eau", "sch", "ción", "in")
    word = lambda: "".join(r.choice(pool) for _ in range(r.randint(1, 3)))
    serial = iter(range(10**6))
    phrase = lambda a, b: f"{' '.join(word() for _ in range(r.randint(a, b)))} {next(serial)}"
    sentence = lambda: f"{phrase(4, 16)}.".capitalize()
    body: set[str] = set()

    def content(text: str) -> str:
        body.add(text)
        return text

    def para() -> str:
        return " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5))))

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{i}'>{phrase(1, 2)}</a></li>" for i in range(n)) + "</ul>"

    def cls(*names: str) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(names)}"'

    def article() -> str:
        parts = []
        title = f"<h1>{content(phrase(1, 12))}</h1>"
        parts.append(f"<header>{title}</header>" if r.random() < 0.2 else title)
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.72:
                t = content(para())
                parts.append(r.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br>", f"<div>{t}</div>", f"<p>{t}")))
            elif kind < 0.78:
                parts.append(f"<h2>{content(phrase(1, 5))}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{content(phrase(2, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{content(para())}</blockquote>")
            elif kind < 0.92:
                parts.append("<table><tr>" + "".join(f"<td>{content(phrase(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
            else:
                parts.append(r.choice((f"<div{cls('ad', 'advert', 'sponsored')}>{para()}</div>", f"<aside>{para()}</aside>", f"<div{cls('share', 'related', 'newsletter')}><p>{para()}</p></div>", f"<form><p>{phrase(2, 4)}</p></form>")))
        inner = "".join(parts)
        return r.choice((f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div{cls('content', 'post', 'entry-content', 'article-body')}>{inner}</div>", f"<section{cls('main', 'story')}>{inner}</section>"))

    before = [r.choice((f"<nav>{links(r.randint(3, 7))}</nav>", f"<div{cls('menu', 'navbar')}>{links(5)}</div>", f"<header><p>{phrase(1, 5)}</p>{links(3)}</header>"))]
    extra = [f"<div{cls('ad', 'banner', 'promo')}>{para()}</div>", f"<div{cls('cookie-notice', 'consent', 'alert')}><p>{para()}</p></div>", f"<div{cls('breadcrumbs')}><a>{phrase(1, 2)}</a></div>", f"<header>{phrase(1, 4)}</header>", f"<form><p>{phrase(1, 4)}</p></form>"]
    before += r.sample(extra, r.randint(0, 3))
    after = r.sample([f"<aside>{links(4)}<p>{para()}</p></aside>", f"<div{cls('sidebar', 'widget')}><h3>{phrase(1, 3)}</h3>{links(4)}<p>{para()}</p></div>", f"<section{cls('comments', 'comment-list', 'discussion')}><h3>{phrase(1, 2)}</h3>" + "".join(f"<div{cls('comment', 'reply')}><p>{para()}</p></div>" for _ in range(r.randint(1, 5))) + "</section>", f"<div{cls('ad')}>{para()}</div>", f"<form><p>{phrase(1, 4)}</p></form>"], r.randint(0, 3))
    after.append(r.choice((f"<footer>{para()}</footer>", f"<footer><p>{phrase(2, 9)}</p>{links(3)}</footer>", f"<div{cls('footer', 'copyright')}><p>{para()}</p></div>")))
    middle = "".join(before) + article() + "".join(after)
    return f"<!DOCTYPE html><html><head><title>{phrase(1, 4)}</title><style>p{{}}</style></head><body>{r.choice((middle, middle, f'<div>{middle}</div>'))}</body></html>", body


def labels_of(page: Page, content: set[str]) -> list[int]:
    """A node is content if most of the text below it is (an empty one: as its parent)."""
    n = len(page.tag)
    good, size = [0] * n, [0] * n
    for owner, text in page.blocks:
        size[owner] += len(text)
        good[owner] += len(text) * (text in content)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        good[page.parent[i]] += good[i]
    out = []
    for i in range(n):
        out.append(int(2 * good[i] > size[i]) if size[i] else out[page.parent[i]] if i else 0)
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 7, pages: int = TRAINING_PAGES) -> TreeModel:
    """Piecewise training: logistic node weights, and parent-child potentials from the labels' joint frequencies."""
    r = random.Random(seed)
    rows, y, joint = [], [], np.ones((2, 2))
    for _ in range(pages):
        source, content = training_page(r)
        page = Page(source)
        truth = labels_of(page, content)
        for i, on in enumerate(node_features(page)):
            row = np.zeros(len(FEATURES))
            row[on] = 1
            rows.append(row)
            y.append(truth[i])
            if i:
                joint[truth[page.parent[i]], truth[i]] += 1
    x, t = np.array(rows), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (t - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    pair = joint / joint.sum()
    pair /= pair.sum(1, keepdims=True) * pair.sum(0, keepdims=True)
    return TreeModel(w.tolist(), pair.tolist())


def extract(source: str | None, model: TreeModel) -> str:
    """The main text of a page."""
    page = Page(source or "")
    if not page.blocks:
        return ""
    if len(page.tag) == 1:
        return "\n\n".join(t for _, t in page.blocks)
    p = model.marginals(page.parent, node_features(page))
    return "\n\n".join(t for owner, t in page.blocks if p[owner] > 0.5)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    model = trained()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(h, model) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
