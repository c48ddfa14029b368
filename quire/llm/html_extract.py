"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at every tag that isn't inline. A block has its number of words and link
density, those of the blocks before and after it, and what its surroundings say. These are told
apart by depth: page parts (menu, header, footer, sidebar, form) and names that hint at adverts,
notices or widgets count below the innermost article element and above it separately, since a
page's wrappers are often called after what stands beside the article. Besides there are what an
element says of reader comments, which of the page's articles a block is in, and how that one
compares in words with the largest, and whether it is a paragraph, a list item or a table cell. A
decision tree (CART) that is trained on a small labelled table says which blocks are main text; the
table has pages that mark their article and pages that don't, short ones among both.

Defined results: null and empty html, and pages without main text, give an empty text; broken
markup is read as far as it goes (a tag that never ends is text, an element that never ends lasts
as long as its parent, a comment that never ends takes the rest), in time linear in the page's
length; very long pages are read whole; repeated rows give repeated results; an empty table gives
no row. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import map_batches, slices, texts_of

#: Names of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder mstyle".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("annotation annotation-xml button canvas datalist iframe noscript object option script select style svg template textarea title audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ELEMENTS = dict.fromkeys("p blockquote pre figcaption".split(), 1) | dict.fromkeys("li dt dd".split(), 2) | dict.fromkeys("td th caption".split(), 3)
PARTS = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Words of class, id and role values that hint at what isn't article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal newsletter subscribe signup login "
    "comment comments discussion replies reply disqus respond sidebar side widget related recommended share sharing social breadcrumb breadcrumbs menu nav navigation navbar footer header "
    "masthead toolbar pagination pager tags complementary contentinfo search".split()
)
MAIN_HINTS = frozenset("main article content post entry story".split())

#: Words that name reader comments.
TALK = frozenset("comment comments discussion replies reply disqus respond".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_QUOTES = re.compile("[>\"']")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CLOSED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    place: Place


@dataclass(slots=True)
class Place:
    """What is known of an element's surroundings. kind: 2 in an article element, 1 in one that
    only its names call so, 0 in none; article: which of them; parts and hints are counted below
    that element, parts_above and hints_above outside it."""

    name: str = ""
    kind: int = 0
    article: int = -1
    parts: int = 0
    header: int = 0
    hints: int = 0
    parts_above: int = 0
    hints_above: int = 0
    talk: int = 0
    heading: int = 0


def named(attributes: str) -> tuple[bool, bool, bool]:
    """Do class, id and role hint at what isn't article, at an article, at reader comments? A name
    of several words hints if half of them do: a search-results-explained is no search form."""
    names = [[w for w in _SPLIT.split(x) if w] for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()]
    hint = any(2 * sum(w in HINTS for w in ws) >= len(ws) for ws in names if ws)
    words = {w for ws in names for w in ws}
    return hint or bool(_HIDDEN.search(attributes)), bool(words & MAIN_HINTS), any(2 * sum(w in TALK for w in ws) >= len(ws) for ws in names if ws)


def inside(up: Place, name: str, attributes: str, articles: int) -> Place:
    """The surroundings of what lies in an element, from those of the element."""
    hint, main, talk = named(attributes) if attributes else (False, False, False)
    kind = 2 if name in ("article", "main") else int(main and name in ("div", "section"))
    frame = name in ("html", "body")
    talk, heading = up.talk or int(talk and not frame), up.heading or int(name in HEADINGS)
    if kind == 2 or kind > up.kind:
        return Place(name, kind, articles, 0, 0, 0, up.parts_above + up.parts + up.header, up.hints_above + up.hints + hint, talk, heading)
    if frame:
        return Place(name, up.kind, up.article, up.parts, up.header, up.hints, up.parts_above, up.hints_above + hint, talk, heading)
    header = name == "header"
    return Place(name, up.kind, up.article, up.parts + (name in PARTS and not header), up.header + header, up.hints + hint, up.parts_above, up.hints_above, talk, heading)


class TagEnds:
    """Where tags end: at the first > that isn't quoted. As soon as one has no end, the ends for
    all places where one might begin are found at once, so that broken markup costs no more."""

    def __init__(self, page: str):
        self.page, self.at, self.last = page, None, page.rfind(">")

    def __call__(self, start: int) -> int | None:
        if start > self.last:
            return None
        if self.at is None:
            if m := _ATTRIBUTES.match(self.page, start):
                return m.end() - 1
            self.prepare()
        return self.ends[bisect_left(self.at, start)]

    def prepare(self) -> None:
        found = [(m.start(), m[0]) for m in _QUOTES.finditer(self.page)]
        self.at = [p for p, _ in found]
        self.ends: list[int | None] = [None] * (len(found) + 1)
        later: dict[str, int] = {}
        for k in range(len(found) - 1, -1, -1):
            place, sign = found[k]
            if sign == ">":
                self.ends[k] = place
            else:
                self.ends[k] = self.ends[later[sign] + 1] if sign in later else None
                later[sign] = k


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[Place] = [Place()]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    link_depth = articles = 0  # depth of the stack where the open link began, 0 if none is open
    tag_end, unclosed = TagEnds(page), set()
    known: dict[tuple[int, str], Place] = {}  # by parent and name, of elements without attributes
    places = list(stack)

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append(Block(words, words.count(" ") + 1, len("".join(linked).split()), stack[-1]))
            text.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if link_depth:
                linked.append(raw)

    def close(i: int) -> None:
        for place in stack[i:]:
            opened[place.name] -= 1
        del stack[i:]

    at = scan = 0
    while (lt := page.find("<", scan)) >= 0:
        scan = lt + 1
        if page.startswith("<!--", lt):
            add(page[at:lt])
            at = scan = page.find("-->", lt + 4) + 3
            if at == 2:
                at = len(page)
                break
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page[scan : scan + 1] in ("!", "?", "/") and lt < tag_end.last:
                add(page[at:lt])
                at = scan = page.find(">", lt) + 1
            continue
        end = tag_end(m.end())
        if end is None:
            continue
        add(page[at:lt])
        at = scan = end + 1
        closing, name, attributes = m[1], m[2].lower(), page[m.end() : end]
        if name in SKIPPED and not closing:
            if name not in INLINE:
                text.append(" ")
            if not attributes.endswith("/") and name not in unclosed:
                found = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                if found and found.end() <= tag_end.last:
                    at = scan = page.find(">", found.end()) + 1
                elif name in RAW:
                    at = len(page)
                    break
                else:
                    unclosed.add(name)  # nor is there an end for later ones
            continue
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name == "a":
                link_depth = 0 if closing else len(stack)
                linked.append(" ")
            continue
        flush()
        if closing:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
        elif name not in VOID and not attributes.endswith("/"):
            if stack[-1].name == "p" and name not in INLINE:
                close(len(stack) - 1)
            elif stop := _CLOSED_BY.get(name):
                for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if stack[i].name == name:
                        close(i)
                        break
                    if stack[i].name in stop:
                        break
            up = stack[-1]
            here = None if attributes else known.get((id(up), name))
            if here is None:
                here = inside(up, name, attributes, articles)
                places.append(here)  # so that its id stays its own
                if not attributes and here.article == up.article:
                    known[id(up), name] = here
                articles += here.article != up.article
            stack.append(here)
            opened[name] += 1
        if link_depth > len(stack):
            link_depth = 0
    add(page[at:])
    flush()
    return out


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "kind", "parts", "hints", "parts_above", "hints_above", "talk", "heading", "element", "article", "share", "best_kind",
)


def features(found: list[Block]) -> np.ndarray:
    """A row for each block. article: how many others the page has before the block's own; share:
    its words by those of the page's largest article; best_kind: the highest kind of the page."""
    own = np.array([(b.words, min(b.linked / b.words, 1.0)) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    sizes: Counter[int] = Counter()
    for b in found:
        sizes[b.place.article] += b.words if b.place.kind else 0
    order = {a: i for i, a in enumerate(sorted(a for a in sizes if a >= 0))}
    most, best = max([*sizes.values(), 1]), max((b.place.kind for b in found), default=0)
    rest = []
    for b in found:
        p = b.place
        parts = p.parts + (p.header if not (p.kind and p.heading) else 0)  # an article's own header may hold its heading
        rest.append((p.kind, min(parts, 2), min(p.hints, 2), min(p.parts_above, 2), min(p.hints_above, 2), p.talk, p.heading, ELEMENTS.get(p.name, 0), min(order.get(p.article, 0), 3), sizes[p.article] / most if p.kind else 0.0, best))
    return np.hstack([own, np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:], np.array(rest, float).reshape(-1, len(FEATURES) - 6)])


@dataclass
class Node:
    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Node:
    """CART: the split with the lowest Gini impurity, as long as it lowers it."""
    node = Node(bool(2 * y.sum() > len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(v))
        left, total = np.cumsum(t)[:-1], t.sum()
        right = total - left
        impurity = 2 * left * (1 - left / n) + 2 * right * (1 - right / (len(v) - n))
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = np.inf
        k = int(impurity.argmin()) if len(impurity) else 0
        if len(impurity) and impurity[k] < best[0]:
            best = (impurity[k], f, (v[k] + v[k + 1]) / 2)
    if best[1] < 0:
        return node
    node.feature, node.limit = best[1], best[2]
    below = x[:, node.feature] <= node.limit
    node.low, node.high = grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)
    return node


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0 or not len(x):
        return np.full(len(x), node.keep)
    below = x[:, node.feature] <= node.limit
    out = np.empty(len(x), bool)
    out[below], out[~below] = decide(node.low, x[below]), decide(node.high, x[~below])
    return out


def labelled_table(pages: int = 1000, seed: int = 11) -> list[tuple[str, str]]:
    """Small pages, and for each of their blocks in turn 1 (main text) or 0. Prose of n words is
    written w*n here, so that the table stays readable."""
    rng = random.Random(seed)
    n = lambda low, high: f"w*{rng.randint(low, high)}"

    def page(*parts: tuple[str, str]) -> tuple[str, str]:
        return re.sub(r"w\*(\d+)", lambda m: " ".join(["word"] * int(m[1])), "".join(markup for markup, _ in parts)), "".join(keep for _, keep in parts)

    def noise(kind: str) -> tuple[str, str]:
        made = {
            "menu": lambda: ("<nav><ul>" + "".join(f"<li><a>{n(1, 3)}</a></li>" for _ in range(3)) + "</ul></nav>", "000"),
            "links": lambda: (f"<div><a>{n(1, 2)}</a></div><div><a>{n(1, 3)}</a></div><div><a>w*1</a> w*1</div>", "000"),
            "cards": lambda: ("".join(f"<a><div>{n(2, 12)}</div></a>" for _ in range(3)), "000"),
            "header": lambda: (f"<header>{n(1, 30)}</header>", "0"),
            "footer": lambda: (f"<footer>{n(3, 60)}<p>{n(1, 20)}</p></footer>", "00"),
            "aside": lambda: (f"<aside><p>{n(3, 90)}</p><p><a>{n(1, 6)}</a></p></aside>", "00"),
            "form": lambda: (f"<form>{n(1, 6)}<p>{n(2, 60)}</p></form>", "00"),
            "ad": lambda: (f"<div class=ad>{n(3, 80)}</div>", "0"),
            "notice": lambda: (f"<div class='cookie notice'><p>{n(5, 70)}</p></div>", "0"),
            "talk": lambda: (f"<section id=comments><h2>w*1</h2><p>{n(1, 120)}</p><p>{n(1, 90)}</p></section>", "000"),
            "talks": lambda: ("<div id=comments>" + "".join(f"<article class=comment><p>{n(1, 100)}</p></article>" for _ in range(2)) + "</div>", "00"),
            "stray": lambda: (f"<div>{n(2, 60)}</div>", "0"),
            "foot": lambda: (f"<div>{n(2, 9)}</div>", "0"),
        }
        return made[kind]()

    def some(kinds: str, most: int) -> list[tuple[str, str]]:
        names = kinds.split()
        return [noise(k) for k in rng.sample(names, rng.randint(0, min(most, len(names))))]

    def prose(low: int = 5) -> tuple[str, str]:
        return f"<p>{n(low, 150)}</p>", "1"

    def body() -> list[tuple[str, str]]:
        kinds = [
            lambda: (f"<p>{n(1, 4)}</p>", "1"),
            prose,
            prose,
            lambda: (f"<p>{n(6, 30)} <a>{n(1, 9)}</a></p>", "1"),
            lambda: (f"<p>{n(20, 60)}</p><p><a>{n(3, 12)}</a></p><p>{n(20, 60)}</p>", "111"),  # a linked line within prose
            lambda: (f"<ul><li>{n(3, 20)}</li><li><a>{n(1, 4)}</a></li><li>{n(3, 20)}</li></ul>", "111"),
            lambda: (f"<ul>{''.join(f'<li><a>{n(1, 8)}</a></li>' for _ in range(3))}</ul>", "111"),  # sources, say
            lambda: (f"<blockquote>{n(2, 40)}</blockquote><figure><figcaption>{n(2, 12)}</figcaption></figure>", "11"),
            lambda: (f"<table><tr><th>{n(1, 3)}</th><td>{n(1, 5)}</td></tr><tr><td><a>{n(1, 2)}</a></td></tr></table>", "111"),
            lambda: (f"<div>{n(10, 90)}</div>", "1"),
            lambda: (f"<h2>{n(1, 9)}</h2>" + prose(9)[0], "11"),
        ]
        inner = [rng.choice(kinds)() for _ in range(rng.randint(1, 6))]
        for k in rng.sample("ad aside form notice".split(), rng.randint(0, 2)):
            inner.insert(rng.randint(0, len(inner)), noise(k))
        teaser = [(f"<div><a>{n(8, 60)}</a></div><div>{n(5, 80)}</div>", "00")] if rng.random() < 0.8 else []  # of what the link before leads to
        return inner + ([prose(15), noise(rng.choice(["links", "cards"])), *teaser] if rng.random() < 0.4 else [])

    out = []
    for _ in range(pages):
        before, after = some("header menu links ad notice aside", 4), some("talk talks aside form ad footer notice cards", 4)
        wrap, unwrap = "", ""
        for markup, close, chance in (("<body class='right-sidebar comments'>", "</body>", 0.2), ("<form id=aspnetForm>", "</form>", 0.15), ("<div class='page-with-sidebar'>", "</div>", 0.2), ("<div class='content-with-sidebar'>", "</div>", 0.2)):
            if rng.random() < chance:
                wrap, unwrap = wrap + markup, close + unwrap
        if rng.random() < 0.6:  # a page that marks its article
            name = rng.choice(["article", "article", "main", "div"])
            names = "class=post" if name == "div" else rng.choice(["", "", "class='post tag-news tags'", "class=search", "class='entry share'", "class='story comments-open'"])
            stray = [noise("stray") for _ in range(rng.randint(0, 2))] if "content" not in wrap else []
            head = (f"<header><h1>{n(1, 12)}</h1></header>", "1") if rng.random() < 0.3 else (f"<h1>{n(1, 12)}</h1>", "1")
            more = [x for _ in range(rng.randint(1, 2)) for x in ((f"<{name} {names}>", ""), *body(), (f"</{name}>", ""))] if rng.random() < 0.15 else []
            out.append(page(*(before if "content" not in wrap else []), (wrap, ""), *stray, (f"<{name} {names}>", ""), head, *body(), (f"</{name}>", ""), *more, *some("talk talks", 1), (unwrap, ""), *after, *stray))
        else:  # one that doesn't
            plain = [
                lambda: prose(1),
                lambda: prose(1),
                lambda: prose(25),
                lambda: (f"<p>{n(6, 40)} <a>{n(1, 4)}</a></p>", "1"),
                lambda: (f"<h2>{n(1, 9)}</h2>{prose(3)[0]}", "11"),
                lambda: (f"<ul><li>{n(1, 20)}</li><li>{n(1, 20)}</li><li>{n(3, 9)} <a>{n(1, 3)}</a></li></ul>", "111"),
                lambda: (f"<blockquote>{n(2, 40)}</blockquote><pre>{n(2, 40)}</pre>", "11"),
                lambda: (f"<figure><figcaption>{n(2, 12)}</figcaption></figure>{prose(9)[0]}", "11"),
                lambda: (f"<table><tr><th>{n(1, 3)}</th><td>{n(1, 5)}</td></tr></table>", "11"),
                lambda: (f"<div>{n(30, 120)}</div>", "1"),
                lambda: (f"<div>{n(20, 120)}</div>", "1"),
            ]
            head = [(f"<h1>{n(1, 12)}</h1>", "1")] if rng.random() < 0.6 else []
            text = [rng.choice(plain)() for _ in range(rng.choice([1, 1, 1, 2, 3, 5]))]
            short = [(f"<div>{n(1, 12)}</div>", "0")] if rng.random() < 0.4 else []
            if rng.random() < 0.2:  # text without any elements of its own
                text, short = [(f"<div>{n(15, 120)}</div>", "1") for _ in range(rng.randint(1, 2))], []
            out.append(page(*before, *head, *text, *after, *short))
    return out


@lru_cache(maxsize=1)
def tree() -> Node:
    x, y = [], []
    for body, keep in labelled_table():
        found = blocks(body)
        if len(found) != len(keep):
            raise ValueError("a labelled page has other blocks than labels")
        x.append(features(found))
        y += [int(k) for k in keep]
    return grow(np.vstack(x), np.array(y))


def main_text(page: str) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = decide(tree(), features(found))
    return "\n\n".join([b.text for b, k in zip(found, keep.tolist(), strict=True) if k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            text = [main_text(p) for p in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), run, f"page_id {kind}, url string, text string, n_chars long")
