"""Operator 11: HTML extraction by composite text density.

A page becomes a tree. Elements that are never article text (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are left out, by element, role, or the names in class and id. Every
other node gets its composite text density: characters for each tag, adjusted
by the characters and tags inside links, with the page's own share of link
text in the base of the logarithm. The node with the greatest sum of its
children's densities is the centre; the least density on its path up to the
body is the threshold, and at every node that reaches it the subtree with the
greatest sum is taken too. What is taken grows to the ``article`` or ``main``
around it, so that titles and short paragraphs stay, and is written as
blocks in page order.

Null, empty and text-free pages give an empty text, a page without tags its
whole text. White space (Unicode's, no-break spaces and line breaks by ``br``
included) is one space inside a block. Very long and deeply nested pages are
read whole, in linear time; beyond :data:`DEPTH` open elements further ones
are laid side by side. Repeated rows are each extracted; an empty table gives
none, and null ids stay. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template iframe noembed noframes object embed svg math canvas audio video map title textarea select datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table caption colgroup tbody thead tfoot tr td th ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag (left) ends open elements (right) up to the nearest element that bounds them.
ENDS_PARAGRAPH = BLOCKS - frozenset("body html caption colgroup tbody thead tfoot tr td th option optgroup legend".split())
ENDS = {t: frozenset(("p",)) for t in ENDS_PARAGRAPH} | {
    "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "option": frozenset(("option",)), "optgroup": frozenset(("option", "optgroup")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("td", "th", "tr")), "tbody": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), "tfoot": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")), "body": frozenset(("head",))}
BOUNDS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tr": frozenset(("table",)), "tbody": frozenset(("table",)), "tfoot": frozenset(("table",))}
SCOPE = frozenset("html body table td th caption button object template".split())

# What is not the article, by element, ARIA role, and word of a class or id.
OUTSIDE = frozenset("nav footer aside header form dialog menu button search noscript".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer comment comments commentlist disqus replies "
    "newsletter subscribe signup popup modal pagination pager masthead gdpr".split())
#: These count only where the rest of the name is made of such words and affixes; text about them has them too.
ALONE = frozenset("header aside top topbar banner promo promoted related recommended search login notice notices social share sharing cookie cookies consent respond overlay toolbar widget widgets alert".split())
AFFIXES = frozenset(
    "site page main global left right primary secondary post posts entry article articles bar box block list links link section wrapper wrap container inner outer area form button buttons icons icon message messages "
    "stories items item content law policy text title body reply thread count".split())
NOT_THE_THING = frozenset("has no with without is not open closed enabled disabled".split())
LANDMARKS = frozenset(("article", "main"))

DEPTH = 512
_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
_QUOTE_OR_END = re.compile(r"=\s*+([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?+")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Page:
    """Nodes in page order: tag, parent, whether hidden or named as outside the article; and the events open, text, close."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.hidden, self.named, self.by_name = [""], [-1], [False], [False], [False]
        self.events: list[int | str] = []
        self._open: list[int] = [0]
        self._counts: dict[str, int] = {}
        self._parse(html)

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            node = self._open.pop()
            self._counts[self.tags[node]] -= 1
            self.events.append(~node)

    def _close(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` inside the nearest of ``bounds``."""
        if not any(self._counts.get(t) for t in tags):
            return
        found = 0
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in tags:
                found = depth
            elif tag in bounds:
                break
        if found:
            self._close_to(found)

    def _start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body") and self._counts.get(tag):
            return
        if tag in ENDS:
            self._close(ENDS[tag], BOUNDS.get(tag, SCOPE))
        if tag in HEADINGS and self.tags[self._open[-1]] in HEADINGS:
            self._close_to(len(self._open) - 1)
        node, found = len(self.tags), attributes(raw) if raw.strip(" /") else {}
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        style = found.get("style", "").lower().replace(" ", "")
        self.hidden.append(tag in HIDDEN or "hidden" in found or "display:none" in style or "visibility:hidden" in style)
        self.named.append(tag in OUTSIDE or found.get("role", "").lower() in ROLES or named_outside(tag, found))
        self.by_name.append(self.named[-1] and tag not in OUTSIDE and found.get("role", "").lower() not in ROLES)
        self.events.append(node)
        if tag in VOID or len(self._open) > DEPTH:
            self.events.append(~node)
        else:
            self._open.append(node)
            self._counts[tag] = self._counts.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if self._counts.get(tag) and tag not in ("html", "body"):
            depth = len(self._open) - 1
            while self.tags[self._open[depth]] != tag:
                if self.tags[self._open[depth]] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    return  # an end tag does not reach out of a cell
                depth -= 1
            self._close_to(depth)

    def _text(self, text: str) -> None:
        if text:
            self.events.append(unescape(text) if "&" in text else text)

    def _parse(self, html: str) -> None:
        at, n, last = 0, len(html), {q: html.rfind(q) for q in "\"'"}
        while m := _TAG.search(html, at):
            self._text(html[at : m.start()])
            if m[3]:  # a comment
                if html.startswith((">", "->"), m.end()):
                    at = html.index(">", m.end()) + 1
                else:
                    at = html.find("-->", m.end()) + 3
                    at = n if at == 2 else at
                continue
            if not m[2]:  # a declaration
                at = html.find(">", m.end()) + 1 or n
                continue
            stop = m.end()
            while (q := _QUOTE_OR_END.search(html, stop)) and q[1]:
                stop = html.index(q[1], q.end()) + 1 if last[q[1]] >= q.end() else q.end()
            at = q.end() if q else n
            tag = m[2].lower()
            if not q:
                break  # a tag that the page's end cuts off
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, html[m.end() : q.start()])
            if tag in RAW and self._open[-1] == len(self.tags) - 1:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else n  # never text of the page
        self._text(html[at:])
        self._close_to(1)


def named_outside(tag: str, found: dict[str, str]) -> bool:
    """Whether a class or id names what is not the article; ids of headings come from their text."""
    if tag in HEADINGS or tag in ("html", "body"):
        return False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w for w in _WORD.findall(_HUMP.sub("-", name).lower()) if w.isalpha()]
        if not words or not NOT_THE_THING.isdisjoint(words):
            continue
        if tag in LANDMARKS:  # an article is one comment or advert, or else the article whatever else it is called
            if words[0] in ("comment", "reply", "ad", "advert", "sponsored", "promo") and AFFIXES.issuperset(words[1:]):
                return True
        elif (len(words) <= 3 and (words[0] in NAMES or words[-1] in NAMES)) or (not AFFIXES.issuperset(words) and all(w in NAMES or w in ALONE or w in AFFIXES for w in words)):
            return True
    return False


def shown(page: Page) -> list[bool]:
    """Nodes that can hold article text.

    Wrappers stay whatever their name: an element that holds an ``article`` or
    ``main`` of its own, a form or noscript with more than half of the page's
    text outside links, and a named element with that much and the page's
    ``h1``. So does the header of an article, if it holds a heading.
    """
    n = len(page.tags)
    chars, landmarks, visible, link, top, heads, within = [0] * n, [0] * n, [True] * n, [False] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        p = page.parents[i]
        visible[i] = visible[p] and not page.hidden[i]
        link[i] = link[p] or page.tags[i] == "a"
        landmarks[i] = page.tags[i] in LANDMARKS and not page.named[i]
        within[i] = within[p] or landmarks[i] > 0
        top[i], heads[i] = int(page.tags[i] == "h1"), int(page.tags[i] in HEADINGS)
    node = 0
    for ev in page.events:
        if isinstance(ev, str):
            chars[node] += len("".join(ev.split())) if visible[node] and not link[node] else 0
        else:
            node = ev if ev >= 0 else page.parents[~ev]
    for i in range(n - 1, 0, -1):
        for sums in (chars, landmarks, top, heads):
            sums[page.parents[i]] += sums[i]
    for i in range(1, n):
        most = 2 * chars[i] > chars[0]
        wrapper = landmarks[i] > 0 or (most and (page.tags[i] in ("form", "noscript") or (page.by_name[i] and top[i] > 0))) or (page.tags[i] == "header" and within[i] and heads[i] > 0)
        visible[i] = visible[page.parents[i]] and not page.hidden[i] and not (page.named[i] and not wrapper)
    return visible


def densities(page: Page, visible: list[bool]) -> tuple[list[float], list[int]]:
    """Composite text density and characters of every node."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    all_chars = all_links = node = 0
    link = [False] * n
    for i in range(1, n):
        link[i] = link[page.parents[i]] or page.tags[i] == "a"
    hidden = page.hidden[:]
    for i in range(1, n):
        hidden[i] = hidden[i] or hidden[page.parents[i]]
    for ev in page.events:
        if isinstance(ev, str):
            size = len(" ".join(ev.split()))
            if not hidden[node]:
                all_chars, all_links = all_chars + size, all_links + size * link[node]
            if visible[node]:
                chars[node] += size
                link_chars[node] += size * link[node]
        else:
            node = ev if ev >= 0 else page.parents[~ev]
    for i in range(n - 1, 0, -1):
        if visible[i]:
            p = page.parents[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            link_tags[p] += link_tags[i] + (page.tags[i] == "a")
    share, out = all_links / max(all_chars, 1), [0.0] * n
    for i in range(n):
        if chars[i]:
            c, t, lc, lt = chars[i], tags[i] or 1, link_chars[i] or 1, link_tags[i] or 1
            base = log(c / max(c - link_chars[i], 1) * lc + share * c + e)
            out[i] = c / t * log(max(c / lc * (t / lt), 1.0)) / log(base)
    return out, chars


def select(page: Page, visible: list[bool]) -> tuple[set[int], float]:
    """Nodes whose subtrees are the main text, and the threshold."""
    n = len(page.tags)
    density, chars = densities(page, visible)
    inside, marked = [False] * n, set()  # inside an article or main, where the page has one with text
    for i in range(1, n):
        inside[i] = visible[i] and (inside[page.parents[i]] or (page.tags[i] in LANDMARKS and chars[i] > 0))
    if not any(inside):
        inside = visible[:]
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        if visible[i]:
            sums[page.parents[i]] += density[i]
    best = list(range(n))  # the node of the greatest sum in each subtree, the outer one of equals
    for i in range(n - 1, 0, -1):
        if visible[i]:
            p = page.parents[i]
            b = best[i]
            if inside[b] and (not inside[best[p]] or sums[b] > sums[best[p]] or (sums[b] == sums[best[p]] and best[p] != p)):
                best[p] = b
    centre = best[0]
    threshold, i = density[centre], centre
    while i > 0:
        i = page.parents[i]
        threshold = min(threshold, density[i])
    covered = [False] * n
    for i in range(n):
        covered[i] = covered[i] or (i > 0 and covered[page.parents[i]])
        if visible[i] and not covered[i] and density[i] >= threshold - 1e-9 and inside[best[i]] and chars[best[i]]:
            marked.add(best[i])
            covered[best[i]] = True
    return _grown(page, marked | ({centre} if chars[centre] else set()), visible), threshold


def _grown(page: Page, marked: set[int], visible: list[bool]) -> set[int]:
    """Marked nodes, each grown to the article or main around it, else joined by headings that lead to it."""
    out, parents = set(), set()
    for i in marked:
        top, j = None, i
        while j > 0 and top is None:
            top, j = (j if page.tags[j] in LANDMARKS else None), page.parents[j]
        out.add(i if top is None else top)
        if top is None and i > 0:
            parents.add((page.parents[i], i))
    before = {}
    for p, i in parents:
        before[p] = max(before.get(p, 0), i)
    if before:
        out |= {j for j in range(1, len(page.tags)) if visible[j] and page.tags[j] in HEADINGS and j < before.get(page.parents[j], 0)}
    return out


def main_text(html: str | None) -> tuple[str, float]:
    """Main text of a page, and the density that its parts reach."""
    page = Page(html or "")
    visible = shown(page)
    chosen, threshold = select(page, visible)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    node, depth = 0, int(0 in chosen)
    for ev in page.events:
        if isinstance(ev, str):
            if depth and visible[node]:
                run.append(ev)
            continue
        i = ev if ev >= 0 else ~ev
        depth += (i in chosen) * (1 if ev >= 0 else -1)
        if page.tags[i] in BLOCKS or i in chosen:
            flush()
        elif page.tags[i] == "br":
            run.append(" ")
        node = ev if ev >= 0 else page.parents[i]
    flush()
    return "\n".join(blocks), threshold


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text, n_chars, threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) for h in b.column(2).to_pylist()]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([x for _, x in found], pa.float64())], names=["page_id", "url", "text", "n_chars", "threshold"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return map_batches(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, threshold double")
