"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, threshold clustering.

One pass of the standard library's event parser turns a page into lines, one per block: its text, its
tags, how much of it is link text, and the element around it. Elements that can never hold the article
(scripts, styles, menus, footers, sidebars, form controls) give no lines. Class, id and role names only
mark: a name made of such words (``ad``, ``comment-list``) or a form is a strong mark, another compound
(``social-security``) a weak one, and what only says that something is or is not there (``has-sidebar``) none.

Links and marks lower the text-to-tag ratio of a line. The ratios are smoothed by a Gaussian; lines above
one standard deviation of the smoothed ratios form the content clusters, and the clusters choose the
region: the ``article`` or ``main`` elements that hold most of their text, or else the innermost element
with nine tenths of it. Whatever wraps the region cannot be boilerplate, however it is marked. Inside the
region every line is kept, short ones too, so smoothing never drops a heading or a last sentence; but
strongly marked elements go, and weakly marked ones whose own ratio stays below the threshold. If
no line stands out, the whole page is the region.

Character references are decoded; white space inside a block becomes one space; blocks stand in page
order, joined by one line feed. Broken markup is closed as browsers do for paragraphs and list items.
Null and empty pages give an empty text. Pages are read whole and never cut, in time proportional to
their length, however deep they nest and however many tags stay open.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset(
    "script style noscript template head title nav footer aside button select option textarea input iframe object embed svg canvas audio video map menu dialog".split()
)
REGION = frozenset({"article", "main"})
CONTAINER = frozenset("html body article main section div td blockquote center table tbody tr ul ol dl form".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead"
    " cookie cookies consent notice notices alert popup modal newsletter subscribe signup login search form comment comments disqus reply replies respond related"
    " recommended share sharing social widget toolbar pagination pager skip hidden complementary contentinfo".split()
)
#: Words that, beside a mark, only name a part of the page.
PARTS = frozenset(
    "area bar block bottom box button buttons container group header icons inner item items left link links list outer page panel post posts right section site slot"
    " stories top unit wrap wrapper".split()
)
_PLAIN = MARKS | PARTS
#: Words that say of a mark whether the page has it.
ABOUT = frozenset("has have with without no not show hide is".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset({"ul", "ol", "dl", "table"})
_TOKEN = re.compile(r"[a-z0-9]+")
SIGMA = 1.0
#: What a mark leaves of a line's ratio.
MARKED = 0.2
WEAK, STRONG = 1, 2


def mark_of(value: str) -> int:
    """How strongly the names in a class, id or role mark their element."""
    found = 0
    for name in value.lower().split():
        words = _TOKEN.findall(name)
        if words and not ABOUT.intersection(words) and MARKS.intersection(words):
            found = max(found, STRONG if _PLAIN.issuperset(words) else WEAK)
    return found


class Lines(HTMLParser):
    """Lines of one page, as (text, tags, link characters, node); a node is an element that may hold lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        # Of nodes, by number: name, parent, mark of its own, outermost article or main around it (or itself). Node 0 is the page.
        self.kinds, self.parents, self.marks, self.articles = [""], [-1], [0], [-1]
        self.open: list[tuple[str, bool, bool]] = []  # element, silent, whether it is a node
        self.at: dict[str, list[int]] = {}  # places in ``open`` by element name
        self.blocks: list[int] = []  # places of elements that are not inline
        self.holders: list[int] = []  # places of lists and tables
        self.node, self.silent, self.links = 0, 0, 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, max(1, self.tags), min(self.linked, len(text)), self.node))
        self.text, self.tags, self.linked = [], 0, 0

    def _mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in REGION or tag in ("html", "body"):
            return 0
        inside = self.articles[self.node] >= 0
        found = STRONG if tag == "form" or (tag == "header" and not inside) else 0
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return STRONG
            if name in ("class", "id", "role") and value:
                found = max(found, mark_of(value), STRONG if not inside and "header" in value.lower().split() else 0)
            if name == "style" and value and re.search(r"display\s*:\s*none", value):
                return STRONG
        return found

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            name, silent, node = self.open.pop()
            place = len(self.open)
            self.at[name].pop()
            for places in (self.blocks, self.holders):
                if places and places[-1] == place:
                    places.pop()
            self.silent -= silent
            self.links -= name == "a"
            if node:
                self.node = self.parents[self.node]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            self.tags += 1
            return
        if tag not in INLINE:
            self._end_block(tag)
        self.tags += 1
        if tag in VOID:
            return
        mark, place = self._mark(tag, attrs), len(self.open)
        # An inline element is part of its line: a strong mark silences it there, a weak one means nothing.
        silent = tag in SILENT or (tag in INLINE and mark == STRONG)
        node = tag not in INLINE and (tag in CONTAINER or mark > 0)
        if node:
            outer = self.articles[self.node]
            self.kinds.append(tag)
            self.parents.append(self.node)
            self.marks.append(mark)
            self.node = len(self.kinds) - 1
            self.articles.append(outer if outer >= 0 else self.node if tag in REGION else -1)
        self.open.append((tag, silent, node))
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
        if tag in _HOLDS:
            self.holders.append(place)
        self.silent += silent
        self.links += tag == "a"

    def _end_block(self, tag: str) -> None:
        """A block starts: the line before it ends, and elements that cannot hold it are closed."""
        self.flush()
        last = lambda name: self.at[name][-1] if self.at.get(name) else -1
        if tag in _CLOSES:
            place = max(map(last, ("p", *_CLOSES[tag])))
            if place > (self.holders[-1] if self.holders else -1):
                self._pop(place)
        elif self.blocks and self.blocks[-1] == last("p"):
            self._pop(self.blocks[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if self.at.get(tag):
            self._pop(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian mean of each value and its neighbours within three sigma."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def clusters(ratios: list[float]) -> tuple[list[int], float]:
    """Numbers of the lines in the clusters above one standard deviation of the smoothed ratios, and that threshold."""
    smoothed = smooth(ratios)
    mean = sum(smoothed) / len(smoothed)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in smoothed) / len(smoothed))
    return [i for i, r in enumerate(smoothed) if r > threshold], threshold


def content_lines(lines: list[tuple]) -> list[int]:
    """Clusters of lines that start with (text, tags), neither linked nor marked."""
    return clusters([len(text) / tags for text, tags, *_ in lines])[0]


def _upwards(page: Lines, values: list[int]) -> list[int]:
    """Sums of nodes with all that they hold: children carry higher numbers than their parents."""
    total = list(values)
    for node in range(len(total) - 1, 0, -1):
        total[page.parents[node]] += total[node]
    return total


def region(page: Lines, chosen: list[int]) -> set[int]:
    """Nodes whose lines are kept, by the text of the chosen lines."""
    held, outer = [0] * len(page.kinds), {}
    for i in chosen:
        text, _, _, node = page.lines[i]
        held[node] += len(text)
        article = page.articles[node]
        if article >= 0:
            outer[article] = outer.get(article, 0) + len(text)
    total = sum(held)
    if sum(outer.values()) * 2 > total:
        return set(outer)
    # Nodes with nine tenths of the text lie around one another; the innermost has the highest number.
    return {max(node for node, n in enumerate(_upwards(page, held)) if n >= 0.9 * total)}


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    if not page.rawdata.startswith("<!--"):  # a comment that never ends hides the rest of the page
        page.close()
    page.flush()
    if not page.lines:
        return ""
    nodes = range(1, len(page.kinds))
    under = [False] * len(page.kinds)  # inside a marked element
    for node in nodes:
        under[node] = page.marks[node] > 0 or under[page.parents[node]]
    clear = [(len(text) - linked) / tags for text, tags, linked, _ in page.lines]
    ratios = [r * (MARKED if under[line[3]] else 1.0) for r, line in zip(clear, page.lines)]
    chosen, threshold = clusters(ratios)
    roots = region(page, chosen or list(range(len(page.lines))))

    own_text, own_tags = [0] * len(page.kinds), [0] * len(page.kinds)
    for text, tags, linked, node in page.lines:
        own_text[node] += len(text) - linked
        own_tags[node] += tags
    texts, tags = _upwards(page, own_text), _upwards(page, own_tags)
    keep = [0 in roots] + [False] * (len(page.kinds) - 1)
    for node in nodes:
        if node in roots:
            keep[node] = True
        elif keep[page.parents[node]]:
            mark = page.marks[node]
            keep[node] = mark == 0 or (mark == WEAK and texts[node] > threshold * max(1, tags[node]))
    return "\n".join(text for text, _, _, node in page.lines if keep[node])


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; other columns are not read."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([main_text(h) for h in html], dtype=object)

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), text(F.col(html_column)).alias("text"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
