"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block; scripts, styles and other unseen parts go, and so does each element whose
tag, or whose own class, id or role word by word, names it as no article (menu, footer, advert, comments, ...). Elements
are closed as HTML closes them, so a part without its end tag ends at the next sibling or where the element around it
ends. A named element that holds the page's only article or main element is a wrapper, and stays.

A line weighs its characters, or nothing outside articles if more than LINKED of them are links. Where an article begins
or ends, and between branches of the page (the outermost groups that part its text), WINDOW lines without weight stand.
The weights of WINDOW successive lines are summed at every line: where the sum rises from nothing text surges, where it
falls to nothing text dives, and all lines from the first to the last that weighs between a surge and its dive are one
stretch. The stretch that weighs most is the main text, with the others that weigh at least SHARE of it and with headings
that stand alone right before it; on pages with article containers only stretches inside them count.

Null pages give an empty text. Character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed. Reading is linear in the page's length, whatever quotes or elements stay open. Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import text_slices

#: Lines of a sum; share of links that makes a line of links; share of the heaviest stretch that others need.
WINDOW, LINKED, SHARE = 4, 0.5, 0.25
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
UNSEEN = {"script", "style", "noscript", "template", "svg", "math", "head", "title", "iframe", "object", "canvas", "audio", "video", "map"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "textarea", "label", "fieldset", "input"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"article", "main"}
START = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<=]*)")
DELIMITER = re.compile(r"[>\"']")
#: Elements whose content is text up to their own end tag.
RAW_ENDS = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "noscript", "textarea", "title", "iframe")}
NAMES = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PART = re.compile(r"[a-z]+")
#: Parts of names that tell of a page's layout, so that the name is a wrapper's.
LAYOUT = {"body", "content", "has", "layout", "main", "no", "page", "site", "with", "without", "wrap", "wrapper"}
#: Names of articles that are none.
NO_ARTICLE = {"comment", "comments", "promo", "related", "reply", "search", "sidebar", "sponsored", "teaser"}
SPECIAL = BLOCKS | ASIDE | UNSEEN
WRAPPERS = {"html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template", "head"}
CELLS = {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that part a page.
GROUPS = {"address", "article", "center", "div", "main", "section", "table"}
BARRIERS = {"table", "td", "th", "caption"}
#: Start tags that end an open paragraph, and what keeps them from one further out.
ENDS_P = (BLOCKS - CELLS - {"body", "html"}) | {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
P_STOPS = BARRIERS | {"button", "object"}
#: The elements that a start tag ends, and the elements that it doesn't look beyond.
ENDS = {"li": ({"li"}, BARRIERS | {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, BARRIERS | {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "tr": ({"td", "th", "tr"}, {"table"}), "tbody": (CELLS, {"table"}), "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}), "button": ({"button"}, BARRIERS)}
ENDS |= {"dt": ENDS["dd"], "th": ENDS["td"], "thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
#: Names in class, id or role that mark what is no article.
ASIDE_NAMES = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toc", "toolbar", "topbar", "widget", "widgets"}


def _named(value: str, names: set[str]) -> bool:
    """Whether one of the words, or one of its parts, is such a name and none of its parts tells of a layout."""
    for word in value.split():
        parts = set(PART.findall(word))
        if word in names or (not parts.isdisjoint(names) and (parts.isdisjoint(LAYOUT) or parts <= {"site", *names})):
            return True
    return False


def _aside(name: str, attrs: str, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if name in ("body", "html", "main") or not attrs:
        return False
    for key, value in NAMES.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key in ("class", "id", "role") and _named(value, NO_ARTICLE if name == "article" else ASIDE_NAMES):
            return True
    return False


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether it closes, attributes) of each tag, and (last text, "", False, ""); one pass."""
    find, n, start, at = page.find, len(page), 0, 0
    lost: set[str] = set()  # quotes that don't come again
    while True:
        lt = find("<", at)
        if lt < 0:
            yield page[start:], "", False, ""
            return
        m = START.match(page, lt)
        if not m:
            close = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">" if page.startswith(("<!", "<?", "</"), lt) else ""
            if not close:
                at = lt + 1
                continue
            end = find(close, lt + 2)
            yield page[start:lt], "", False, ""
            if end < 0:
                return
            start = at = end + len(close)
            continue
        end = m.end()
        while True:  # a quote holds off the end of a tag where it begins a value and comes again
            d = DELIMITER.search(page, end)
            if not d or d[0] == ">":
                break
            quote, end = d[0], d.end()
            k = d.start() - 1
            while page[k].isspace():
                k -= 1
            if page[k] == "=" and quote not in lost:
                stop = find(quote, end)
                if stop < 0:
                    lost.add(quote)
                else:
                    end = stop + 1
        name = m[2].lower()
        if not d:
            yield page[start:lt], "", False, ""
            return
        yield page[start:lt], name, m[1] == "/", page[m.end() : d.start()]
        start = at = d.end()
        if name in RAW_ENDS and not m[1]:
            stop = RAW_ENDS[name].search(page, at)
            start = at = stop.start() if stop else n


class Opened:
    """The open elements, closed as HTML closes them; `root` is the place of the one that is skipped, or -1.

    An element closed among others that stay open leaves an empty name in its place, so places never shift.
    """

    def __init__(self) -> None:
        self.names: list[str] = []
        self.where: dict[str, list[int]] = {}  # the places of each name, in order
        self.root = -1
        self.ids: list[int] = []  # of each open element, the innermost group it lies in or is
        self.parents: list[int] = [0]  # of each group; 0 is the page
        self.kinds: list[str] = [""]

    @property
    def group(self) -> int:
        return self.ids[-1] if self.ids else 0

    def open(self, name: str) -> bool:
        return bool(self.where.get(name))

    def last(self, names: set[str]) -> int:
        """The innermost place of any of these names, or -1."""
        return max((at[-1] for x in names if (at := self.where.get(x))), default=-1)

    def push(self, name: str, attrs: str = "") -> None:
        group = self.group
        if name in GROUPS:
            self.parents.append(group)
            self.kinds.append(f"{name} {attrs.strip()}")
            group = len(self.parents) - 1
        self.where.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.ids.append(group)

    def cut(self, at: int) -> None:
        """Close the element at this place and all in it."""
        if at < 0:
            return
        for x in self.names[at:]:
            if x:
                self.where[x].pop()
        while at and not self.names[at - 1]:
            at -= 1
        del self.names[at:], self.ids[at:]
        if at <= self.root:
            self.root = -1

    def outermost(self, names: set[str], stops: set[str]) -> int:
        """The place of the outermost of these elements within the nearest stop."""
        stop = self.last(stops)
        found = [at[k] for x in names if (at := self.where.get(x)) and (k := bisect_right(at, stop)) < len(at)]
        return min(found, default=-1)

    def start(self, name: str) -> None:
        """Close what a start tag closes: paragraphs, items, cells, rows and options may lack their end tags."""
        if self.open("head") and name not in IN_HEAD:
            self.cut(self.where["head"][0])
        for foreign in ("svg", "math"):
            if self.open(foreign) and name in BLOCKS and not self.open("foreignobject"):
                self.cut(self.where[foreign][0])
        if name in ENDS:
            self.cut(self.outermost(*ENDS[name]))
        if name in ENDS_P:
            at = self.outermost({"p"}, P_STOPS)
            if name == "p" or at >= self.root:  # a block in a skipped part of a paragraph is of that part
                self.cut(at)

    def end(self, name: str) -> bool:
        """Close the nearest element of this name; cells and tables hold off stray ends, but not of what is around a skip.

        Tells whether that was the skipped one.
        """
        i = self.last(HEADINGS if name in HEADINGS else {name})
        if i < 0:
            return False
        stops = set() if name in CONTAINERS or name in ("body", "html", "table") else {"table"} if name in CELLS else BARRIERS
        held_off = self.last(stops) > i
        own = i == self.root
        if i == len(self.names) - 1:
            self.cut(i)
        elif name == "form" or name not in SPECIAL:
            self.where[self.names[i]].pop()
            self.names[i] = ""
            self.root = -1 if own else self.root
        elif not held_off or i < self.root:
            self.cut(i)
        return own


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    container: int  # which article or main element it lies in, 0 for none
    group: int
    heading: bool


class Page:
    """A page's lines, its groups, and what was skipped; elements numbered in `wrappers` aren't skipped by name."""

    def __init__(self, page: str, wrappers: frozenset[int] = frozenset()):
        self.lines: list[Line] = []
        self.holders: list[int] = []  # numbers of skipped elements that hold an article or main element
        self.forms: list[tuple[int, int]] = []  # numbers of skipped forms, and characters in each
        self.opened = opened = Opened()
        self.held: list[str] = []
        self.linked, in_link = 0, False
        open_containers: list[int] = []
        containers = number = skipped = seen = 0
        for raw, name, closing, attrs in tags(page):
            if raw:
                if opened.root >= 0 and opened.names[-1] == "head" and raw.strip():
                    opened.cut(opened.root)
                if opened.root < 0:
                    text = html_lib.unescape(raw)
                    self.held.append(text)
                    if in_link:
                        self.linked += len(text.strip())
                else:
                    seen += len(raw.strip())
            if not name:
                continue
            alone = name in VOID or attrs.endswith("/")
            skipping = opened.root >= 0
            if not skipping and name in BLOCKS:
                self._flush(open_containers)
            if skipping:
                if name == "form" and not closing and opened.open("form"):
                    continue
                if name in CONTAINERS and not closing and not _aside(name, attrs, True):
                    self.holders.append(skipped)
                own = opened.end(name) if closing else opened.start(name)
                if own or opened.root >= 0:
                    if not closing and not alone:
                        opened.push(name, attrs)
                    if own and name == "form":
                        self.forms.append((skipped, seen))
                    continue
            elif closing:
                opened.end(name)
            else:
                opened.start(name)
            if not closing and name not in WRAPPERS:
                number += 1
                if name in UNSEEN or (number not in wrappers and _aside(name, attrs, bool(open_containers))):
                    if name not in UNSEEN or name in ("head", "title"):
                        self._flush(open_containers)
                    if not alone:
                        opened.push(name, attrs)
                        opened.root = len(opened.names) - 1
                        skipped, seen = number, 0
                    continue
            if not closing and not alone:
                opened.push(name, attrs)
            if name == "a":
                in_link = not closing
            if name == "br":
                self.held.append(" ")
            elif name in CONTAINERS and closing:
                if open_containers:
                    open_containers.pop()
            elif name in CONTAINERS:
                containers += 1
                open_containers.append(containers)
        self._flush(open_containers)

    def _flush(self, containers: list[int]) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.lines.append(Line(text, self.linked, containers[-1] if containers else 0, self.opened.group, self.opened.last(HEADINGS) >= 0))
            self.held.clear()
        self.linked = 0


def read(page: str) -> Page:
    """The page; where its only articles lie in skipped elements, or most of its text in a form, those are wrappers."""
    wrappers: frozenset[int] = frozenset()
    for _ in range(8):
        got = Page(page, wrappers)
        if any(x.container for x in got.lines):
            break
        size = sum(len(x.text) for x in got.lines)
        more = wrappers.union(got.holders, () if got.holders else [k for k, n in got.forms if n > size])
        if more == wrappers:
            break
        wrappers = more
    return got


def branches(page: Page, weights: list[int]) -> list[int]:
    """The branch of each line: the outermost group that parts the text, below all groups that just wrap the rest."""
    parents = page.opened.parents
    mass, own = [0] * len(parents), [0] * len(parents)
    for x, w in zip(page.lines, weights, strict=True):
        mass[x.group] += w
        own[x.group] += 1
    for g in range(len(parents) - 1, 0, -1):
        mass[parents[g]] += mass[g]
    heavy: dict[int, int] = {}
    for g in range(1, len(parents)):
        if mass[g] > mass[heavy.get(parents[g], 0)] * (parents[g] in heavy):
            heavy[parents[g]] = g
    around, root = {0}, 0
    while not own[root] and root in heavy and 10 * mass[heavy[root]] >= 8 * mass[root] and not own[heavy[root]]:
        root = heavy[root]
        around.add(root)
    of = [0] * len(parents)
    for g in range(1, len(parents)):
        of[g] = -g if g in around else g if parents[g] in around else of[parents[g]]
    return [of[x.group] for x in page.lines]


def distribution(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each place, and the line at it, -1 where none is."""
    weights = [len(x.text) if x.container or x.linked <= LINKED * len(x.text) else 0 for x in page.lines]
    of = branches(page, weights)
    counts: dict[int, int] = {}
    for b in of:
        counts[b] = counts.get(b, 0) + 1
    kinds = page.opened.kinds
    places: list[int] = []
    for k, x in enumerate(page.lines):
        if k:
            a, b, before = of[k - 1], of[k], page.lines[k - 1]
            alike = a > 0 and b > 0 and counts[a] == counts[b] == 1 and kinds[a] == kinds[b]
            if x.container != before.container or (not x.container and a != b and not alike):
                places += [-1] * WINDOW
        places.append(k)
    at = np.array(places, np.int64)
    return np.where(at >= 0, np.array([*weights, 0], np.int64)[at], 0), at


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of places between each surge and the dive that follows it."""
    if not weights.size:
        return []
    sums = np.convolve(weights, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of a place and those after it
    live = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    edges = np.diff(live)
    out = []
    for surge, dive in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        filled = np.flatnonzero(weights[surge:dive]) + surge
        out.append((int(filled[0]), int(filled[-1]) + 1))
    return out


def main_text(page: str | None) -> str:
    got = read(page or "")
    weights, at = distribution(got)
    found = [(int(weights[a:b].sum()), [got.lines[k] for k in at[a:b].tolist() if k >= 0]) for a, b in stretches(weights)]
    if not found and got.lines:  # nothing but links
        found = [(1, got.lines)]
    found = [x for x in found if any(y.container for y in x[1])] or found
    most = max((w for w, _ in found), default=0)
    kept = [w >= SHARE * most for w, _ in found]
    for k in range(len(found) - 2, -1, -1):
        kept[k] |= kept[k + 1] and all(x.heading for x in found[k][1])
    return "\n".join(x.text for keep, (_, lines) in zip(kept, found, strict=True) if keep for x in lines)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, k, pages_ in text_slices(b.column(2)):
                texts = [main_text(x) for x in pages_]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k - i), b.column(1).slice(i, k - i), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def op2(pages: DataFrame) -> DataFrame:
    return extract(pages)
