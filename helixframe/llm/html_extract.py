"""Main text of web pages by a tree-structured graphical model over block elements.

Nodes are a page's block elements. Each is in one of three states: BOILER (menus, adverts, forms,
comments), MIXED (holds both) and CONTENT (main text). A node's potential comes from its features
(tag, words of class, id and role, share of linked text, amount of text); a parent-child potential
joins neighbouring states. Messages go from the leaves up and from the root down (sum-product),
which gives every node's exact marginals. Text right under a node is kept if content is likelier
than not there.

Potentials are frequencies with additive smoothing, counted on the labelled pages of
labelled_pages() and plain_pages(): small pages of many layouts, each block marked, generated from fixed seeds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import prepare

BOILER, MIXED, CONTENT = 0, 1, 2
SMOOTH = 0.1

# Elements that end a text block.
BLOCK = set(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements without content, and those whose content isn't text of the page.
VOID = set("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
HIDDEN = set("script style template noscript textarea iframe object audio video svg math title button canvas datalist noembed noframes xmp".split())
# Open elements that a start tag ends, and where looking for them stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "body": ({"head"}, set()),
}

# Quantifiers are possessive: a tag that never ends costs one pass, not one for each way to divide it.
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|[^<]++|<""", re.S
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Block nodes of a page in order: parent, kind (tag and attribute words), and text pieces with the node they stand in."""

    __slots__ = ("parent", "kind", "text", "own", "linked", "label")

    def __init__(self):
        self.parent: list[int] = [-1]
        self.kind: list[tuple] = [("#page",)]
        self.text: list[tuple[int, str]] = []  # runs of text between block bounds
        self.own, self.linked = [0], [0]  # code points of text and of linked text right under a node
        self.label: list[str] = [""]


@lru_cache(20_000)
def attribute_words(raw: str) -> tuple[tuple[str, ...], str]:
    """Words of class, id and role, marks of hidden elements, and the data-label that labelled pages carry."""
    words: set[str] = set()
    label = ""
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), unescape((m[2] or "").strip("\"'"))
        if name in ("class", "id", "role", "itemprop"):
            words.update("@" + w for w in _NAME.findall(_CAMEL.sub(" ", value).lower()))
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and value == "true":
            words.add("@hidden")
        elif name == "data-label":
            label = value
    return tuple(sorted(words)), label


def parsed(html: str) -> Page:
    """Reads markup as browsers do where it matters for text: void and hidden elements, ends that are left out, stray ends."""
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the block node that each is or stands in
    run: list[str] = []
    links = 0

    def flush() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                page.text.append((stack[-1][1], text))
            run.clear()

    def close(i: int) -> None:
        nonlocal links
        if any(t in BLOCK for t, _ in stack[i:]):
            flush()
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    pos, end = 0, len(html)
    while pos < end:
        m = _TOKEN.match(html, pos)
        pos = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the latter: quotes that don't match
        if tag is None:
            piece = m[0]
            if piece == "<" and html[pos : pos + 1].isalpha():
                break  # a tag that the page ends in
            if piece[0] != "<" or len(piece) == 1:
                piece = unescape(piece)
                run.append(piece)
                node = stack[-1][1]
                n = len(piece) - piece.count(" ") if not piece.isspace() else 0
                page.own[node] += n
                if links:
                    page.linked[node] += n
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK or tag == "a":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in BLOCK and tag == "a":
                        break
                else:
                    if tag == "p":
                        flush()
            elif stack[-1][0] == tag:
                close(len(stack) - 1)
            continue
        if tag in HIDDEN:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
                pos = at.end() if at else end
            continue
        if tag == "br":
            run.append("\n")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            targets, stops = CLOSES.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in targets:
                    close(i)
                    break
                if stack[i][0] in stops:
                    break
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            flush()
            if tag == "hr":
                continue
            words, label = attribute_words(attributes) if attributes else ((), "")
            page.parent.append(stack[-1][1])
            page.kind.append((tag, *words) if words else (tag, "#bare"))
            page.own.append(0)
            page.linked.append(0)
            page.label.append(label)
            stack.append((tag, len(page.parent) - 1))
        else:
            if tag == "a":
                links += 1
            if attributes and "hidden" in attributes:
                words, _ = attribute_words(attributes)
                if "@hidden" in words:
                    at = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                    pos = at.end() if at else pos
                    links -= tag == "a"
                    continue
            stack.append((tag, stack[-1][1]))
    flush()
    return page


def amounts(page: Page) -> tuple[list[int], list[int]]:
    """Code points of text and of linked text in each node's whole subtree (children come after parents)."""
    text, linked = page.own[:], page.linked[:]
    for i in range(len(text) - 1, 0, -1):
        text[page.parent[i]] += text[i]
        linked[page.parent[i]] += linked[i]
    return text, linked


def steps(text: int, linked: int, own: int) -> tuple[str, str, str]:
    """Features of an amount of text, of the share of it that is linked and of the text right under the node."""
    share = 0 if not linked else 1 + (linked > 0.3 * text) + (linked > 0.7 * text)
    return f"#text{(text > 0) + (text > 25) + (text > 100) + (text > 400)}", f"#linked{share}", f"#own{(own > 0) + (own > 25)}"


class Model:
    """Log potentials: of features by state, and of a child's state by its parent's."""

    def __init__(self, pages: list[Page]):
        seen: list[Counter] = [Counter(), Counter(), Counter()]
        total = [0, 0, 0]
        pair = np.full((3, 3), SMOOTH)
        names = {"boiler": BOILER, "mixed": MIXED, "content": CONTENT}
        for page in pages:
            text, linked = amounts(page)
            states = [MIXED]
            for i in range(1, len(page.parent)):
                state = names[page.label[i]] if page.label[i] else states[page.parent[i]]
                states.append(state)
                pair[states[page.parent[i]], state] += 1
                total[state] += 1
                seen[state].update({*page.kind[i], *steps(text[i], linked[i], page.own[i])})
        vocabulary = set().union(*seen)
        self.features = {f: np.array([np.log((seen[s][f] + SMOOTH) / (total[s] + 2 * SMOOTH)) for s in range(3)]) for f in vocabulary}
        self.pair = pair / pair.sum(1, keepdims=True)
        self.kinds: dict[tuple, np.ndarray] = {}

    def unary(self, key: tuple) -> np.ndarray:
        """exp of the summed log potentials of the known features; a memory serves kinds that recur."""
        got = self.kinds.get(key)
        if got is None:
            x = sum((self.features[f] for f in key if f in self.features), np.zeros(3))
            got = np.exp(x - x.max())
            if len(self.kinds) < 100_000:
                self.kinds[key] = got
        return got

    def marginals(self, parent: np.ndarray, depth: np.ndarray, unary: np.ndarray) -> np.ndarray:
        """P(state) of every node of a forest, by messages up and down one level at a time."""
        up = unary.copy()
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        levels = [order[a:b] for a, b in zip(bounds, bounds[1:])]
        message = np.ones_like(unary)
        for level in levels[:0:-1]:
            x = up[level] @ self.pair.T
            x /= x.sum(1, keepdims=True)
            message[level] = x
            top, at = np.unique(parent[level], return_inverse=True)
            s = np.zeros((len(top), 3))
            np.add.at(s, at, np.log(x))
            y = np.log(up[top]) + s
            up[top] = np.exp(y - y.max(1, keepdims=True))
        belief = up.copy()
        for k, level in enumerate(levels):
            if k:
                outside = belief[parent[level]] / message[level]
                belief[level] = up[level] * (outside @ self.pair)
            belief[level] /= belief[level].sum(1, keepdims=True)
        return belief


def labelled_pages(n: int = 600, seed: int = 11) -> list[Page]:
    """Pages of many layouts with each block's state in data-label (children without one have their parent's)."""
    r = Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/x">{words(1, 2)}</a>'
    mark = lambda names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'])

    def menu() -> str:
        tag = r.choice(["nav", "div", "ul", "header"])
        inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 8)))
        inner = f"<ul>{inner}</ul>" if tag != "ul" else inner
        attr = mark(["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "site-nav", "toolbar"]) if tag in ("div", "ul") or r.random() < 0.3 else ""
        return f'<{tag}{attr} data-label="boiler">{inner}</{tag}>'

    def box(tags, names, inner, bare=0.3) -> str:
        tag = r.choice(tags)
        attr = "" if tag != "div" and tag != "section" and r.random() < bare else mark(names)
        return f'<{tag}{attr} data-label="boiler">{inner}</{tag}>'

    ad = lambda: box(["div", "aside", "section", "ins", "p"][:3], ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion"], r.choice([words(3, 25), f"<p>{words(3, 25)}</p>", f"<p>{words(2, 8)} {link()}</p>"]))
    notice = lambda: box(["div", "section", "dialog"], ["cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "banner", "newsletter", "subscribe", "paywall"], r.choice([words(5, 30), f"<p>{words(5, 30)}</p>"]))
    form = lambda: box(["form", "div"], ["search", "login", "signup", "form", "subscribe", "newsletter", "contact"], f"<label>{words(1, 3)}</label><input><p>{words(1, 8)}</p>", 0.8)
    side = lambda: box(["aside", "div", "section"], ["sidebar", "side", "related", "widget", "recommended", "popular", "trending", "more", "share", "social", "tags", "toc"], f"<h3>{words(1, 3)}</h3>" + r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{words(4, 30)}</p>", f"<p>{words(2, 6)} {link()}</p>"]), 0.7)
    comments = lambda: box(["section", "div", "ol", "ul"], ["comments", "comment-list", "comment", "discussion", "replies", "responses", "disqus", "reply"], "".join(f'<{t}{r.choice(["", mark(["comment", "reply"])])}><p>{words(4, 40)}</p></{t}>' for t in [r.choice(["div", "li"] * 6 + ["article"])] for _ in range(r.randint(1, 4))), 0)
    footer = lambda: box(["footer", "div"], ["footer", "copyright", "legal", "bottom", "colophon", "foot"], r.choice([words(3, 20), f"<p>&copy; {words(2, 15)}</p>", f"<p>{link()} {link()} {words(1, 6)}</p>"]), 0.8)
    header = lambda: box(["header", "div"], ["header", "masthead", "logo", "site-header", "top", "hero"], r.choice([words(1, 6), f"<h1>{words(1, 4)}</h1><p>{words(2, 8)}</p>", f"<div>{words(1, 4)}</div>"]), 0.8)

    def body() -> str:
        brief = r.random() < 0.3

        def para() -> str:
            k = r.random()
            if k < 0.65:
                return f"<p>{words(1, 60) if not brief and r.random() < .7 else words(1, 5)}{' ' + link() if r.random() < .15 else ''}</p>"
            if k < 0.72:
                return f"<h{r.randint(2, 4)}>{words(1, 6)}</h2>"
            if k < 0.87:
                return "<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if k < 0.91:
                return f"<blockquote>{words(5, 40)}</blockquote>"
            if k < 0.94:
                return f"<figure><figcaption>{words(2, 10)}</figcaption></figure>"
            if k < 0.97:
                return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
            return f"<div><p>{words(5, 60)}</p></div>"

        parts = [f"<h1>{words(1, 8)}</h1>"] * (r.random() < 0.8) + [para() for _ in range(r.randint(1, 3 if brief else 12))]
        inside = [make() for make in (ad, side, form, notice, comments) if r.random() < 0.12]
        for x in inside:
            parts.insert(r.randint(1, len(parts)), x)
        if r.random() < 0.15:
            return "".join(parts)
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        attr = mark(["content", "article", "post", "entry", "story", "main", "body", "article-body", "post-content", "entry-content", "text"]) if tag in ("div", "section") or r.random() < 0.4 else ""
        inner = "".join(parts)
        if r.random() < 0.2:
            inner = f'<header>{parts[0]}</header>{"".join(parts[1:])}'
        return f'<{tag}{attr} data-label="content">{inner}</{tag}>'

    out = []
    for _ in range(n):
        before = [make() for make in (notice, header, menu, ad, form, side) if r.random() < 0.5]
        after = [make() for make in (side, comments, ad, form, footer, menu) if r.random() < 0.5]
        r.shuffle(before)
        core = body()
        bare = "data-label" not in core[:200].split(">")[0]
        for _ in range(0 if bare else r.choice([0, 0, 0, 1, 2])):
            tag = r.choice(["main", "div", "section"])
            attr = r.choice(["", mark(["wrapper", "container", "page", "row", "main", "site", "layout", "col"])])
            inner = "".join([side()] * (r.random() < 0.3)) + core + "".join([side()] * (r.random() < 0.3))
            core = f'<{tag}{attr} data-label="mixed">{inner}</{tag}>'
        state = "content" if bare else "mixed"
        html = f'<body data-label="{state}">{"".join(before)}{core}{"".join(after)}</body>'
        if r.random() < 0.9:
            html = f'<html data-label="mixed"><head data-label="boiler"><title>{words(2, 5)}</title></head>{html}</html>'
        out.append(parsed(html))
    return out


def plain_pages(n: int = 250, seed: int = 12) -> list[Page]:
    """Labelled pages of the kinds that labelled_pages() lacks: articles in nested divs without a name, lists of links within articles,
    short articles that hold comments."""
    r = Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda a=1, b=2: f'<a href="/x">{words(a, b)}</a>'
    nav = lambda: f'<nav data-label="boiler"><ul>{"".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7)))}</ul></nav>'
    foot = lambda: f'<footer data-label="boiler">{r.choice([words(2, 12), f"<p>&copy; {words(2, 10)}</p>", f"<p>{link()} {link()}</p>"])}</footer>'
    talk = lambda: f'<{(t := r.choice(["div", "section"]))} class="comments" data-label="boiler">{"".join(f"<div{c}><p>{words(3, 40)}</p></div>" for c in [r.choice(["", chr(32) + "class=comment"]) for _ in range(r.randint(1, 4))])}</{t}>'
    listed = lambda: f'<{(t := r.choice(["ul", "ol"]))}>{"".join(f"<li>{link(1, 9)}{r.choice(["", " " + words(1, 8)])}</li>" for _ in range(r.randint(2, 7)))}</{t}>'

    def body(short: bool) -> str:
        parts = [f"<h{r.randint(1, 2)}>{words(1, 8)}</h1>"] * (r.random() < 0.8)
        for _ in range(r.randint(1, 2 if short else 7)):
            parts.append(listed() if r.random() < 0.25 else f"<p>{words(2, 12 if short else 50)}{' ' + link() if r.random() < .2 else ''}</p>")
        return "".join(parts)

    out = []
    for _ in range(n):
        short = r.random() < 0.5
        inner = body(short) + talk() * (r.random() < (0.6 if short else 0.2))
        if r.random() < 0.6:
            for k in range(r.randint(1, 3)):
                inner = f'<div data-label="{"mixed" if k and r.random() < 0.5 else "content"}">{inner}</div>'
        else:
            inner = f'<{(t := r.choice(["article", "main"]))} data-label="content">{inner}</{t}>'
        html = nav() * (r.random() < 0.8) + inner + foot() * (r.random() < 0.8)
        if r.random() < 0.4:
            html = f'<div data-label="mixed">{html}</div>'
        out.append(parsed(f'<html data-label="mixed"><head data-label="boiler"><title>{words(2, 5)}</title></head><body data-label="mixed">{html}</body></html>'))
    return out


@lru_cache(1)
def model() -> Model:
    return Model(labelled_pages() + plain_pages())


def extract(htmls: list[str], m: Model | None = None) -> list[tuple[str, float]]:
    """Main text of each page, and the least probability of content among its kept blocks (1 without any)."""
    m = m or model()
    pages = [parsed(h) for h in htmls]
    parents, depths, unary, starts = [], [], [], [0]
    for page in pages:
        text, linked = amounts(page)
        base, depth = starts[-1], [0] * len(page.parent)
        for i in range(1, len(page.parent)):
            depth[i] = depth[page.parent[i]] + 1
        parents += [max(p, 0) + base for p in page.parent]
        depths += depth
        unary.append(np.array([0.0, 1.0, 1.0 if len(page.parent) > 1 else 9.0]) + 1e-9)  # a page without blocks is its text
        unary += [m.unary((*page.kind[i], *steps(text[i], linked[i], page.own[i]))) for i in range(1, len(page.parent))]
        starts.append(base + len(page.parent))
    p = m.marginals(np.array(parents), np.array(depths), np.maximum(np.array(unary), 1e-9)) if pages else None
    out = []
    for page, start in zip(pages, starts):
        content = [(t, p[start + i, CONTENT]) for i, t in page.text if p[start + i, CONTENT] > 0.5]
        out.append(("\n\n".join(t for t, _ in content), float(min((x for _, x in content), default=1.0))))
    return out


def main_text(pages: DataFrame, fitted: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points), confidence of each row's whole html.

    Text: blocks in page order joined by two line feeds; white space within a block is one blank.
    Null or empty html, and pages without main text: empty text, 0. Null page_id or url stay;
    repeated rows repeat; other columns are left out.
    """
    prepare(pages.sparkSession)
    fitted = fitted or model()  # a few hundred numbers, fitted once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                c = b.slice(at, 200)
                got = extract([h or "" for h in c.column(2).to_pylist()], fitted)
                text = [t for t, _ in got]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([x for _, x in got], pa.float64())], names=["page_id", "url", "text", "n_chars", "confidence"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, confidence double")
