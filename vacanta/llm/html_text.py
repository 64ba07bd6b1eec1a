"""Main text of web pages by composite text density.

A page becomes a tree of elements. For every node the characters per tag are computed and adjusted for
links (composite text density); a node's density sum adds its children's densities. The subtree of the
greatest density sum is the article's core. The lowest density on the path from there to the body is
the threshold: the selection climbs while a neighbour is as dense as that, but not out of an enclosing
``article`` element. Parts that are no article text by their element or class (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) count nowhere. Beside an article a
class or id names such a part if one of its words does; inside an article only if it has no other words
than that and such as "box" or "list", so that sections on related work or social history stay.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one space in page order; ``br`` ends a block.

Defined results: a null or empty page, or one without text, gives the empty text; a page without any
tags is its own text; of equal density sums the first node wins; repeated rows are treated alike; an
empty table gives an empty table; columns named like an output are replaced. A page is parsed as a
whole whatever its length, without recursion, in time that grows with its length: a tag that is not closed
ends at the next "<", and open elements are found by name.
"""

from __future__ import annotations

import bisect
import html
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vacanta.llm.batches import appended, blocks, for_texts, schema_with

#: Elements whose content is raw text up to their end tag.
RAW = "script|style|xmp|iframe|noembed|noframes|textarea|title"
TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\"><])*+>(.*?)(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"><])*+)(?:>|(?=<))",
    re.DOTALL | re.IGNORECASE,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: Elements that hold no article text wherever they stand.
DROPPED = frozenset(
    "nav footer aside form head script style noscript template svg math canvas object applet audio video iframe dialog button select "
    "option input textarea fieldset menu map".split()
)
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that name parts beside the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promotions banner banners "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search comment comments "
    "commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar pagination "
    "pager skip".split()
)
#: Words that say nothing of what a part of that name holds.
NEUTRAL_WORDS = frozenset(
    "box block list container wrapper area section slot unit bar panel form reader readers user article post page site main left right top bottom inner outer row item "
    "items link links text title primary secondary".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: A start tag of the key ends an open element of the value's kinds, up to a border.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",),
}
BORDERS = frozenset("html body article section main div table ul ol dl blockquote td th aside nav header footer form fieldset figure details".split())
PARAGRAPH_BORDERS = frozenset("html body table td th button object caption".split())


class Page:
    """Elements in page order, their texts, and what each subtree adds up to."""

    def __init__(self, source: str, by_class: bool = True):
        self.tag, self.parent, self.end = ["#page"], [-1], [0]
        self.dropped = [False]
        #: (element, text) in page order; None as text ends a block.
        self.parts: list[tuple[int, str | None]] = []
        self.by_class = by_class
        self._parse(source)

    def _is_dropped(self, tag: str, attributes: str, inside_article: bool) -> bool:
        if tag in DROPPED or (tag == "header" and not inside_article):
            return True
        if not self.by_class or not attributes or tag in ("html", "body", "article", "main"):
            return False
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = a or b or c
            if name.lower() == "role":
                if value.strip().lower() in DROPPED_ROLES:
                    return True
                continue
            if inside_article:
                for one in value.split():
                    words = {w.lower() for w in WORD.findall(one) if not w.isdigit()}
                    if words & DROPPED_WORDS and words <= DROPPED_WORDS | NEUTRAL_WORDS:
                        return True
                continue
            words = {w.lower() for w in WORD.findall(value)}
            if words & DROPPED_WORDS or ("header" in words and not words & {"article", "post", "entry", "story", "content"}):
                return True
        return False

    def _parse(self, source: str) -> None:
        tag, parent, dropped, parts, stack = self.tag, self.parent, self.dropped, self.parts, [0]
        articles, at = 0, 0
        # Depths of open elements: by name, and of the two kinds of borders.
        named: dict[str, list[int]] = {}
        borders, paragraph_borders = [0], [0]

        def push(node: int, name: str) -> None:
            nonlocal articles
            named.setdefault(name, []).append(len(stack))
            if name in BORDERS:
                borders.append(len(stack))
            if name in PARAGRAPH_BORDERS:
                paragraph_borders.append(len(stack))
            stack.append(node)
            articles += name == "article"

        def pop_to(depth: int) -> None:
            nonlocal articles
            while len(stack) > depth:
                node = stack.pop()
                name = tag[node]
                self.end[node] = len(tag)
                articles -= name == "article"
                if len(stack):
                    named[name].pop()
                    if name in BORDERS:
                        borders.pop()
                    if name in PARAGRAPH_BORDERS:
                        paragraph_borders.pop()
                if name not in INLINE:
                    parts.append((node, None))

        def nearest(name: str) -> int:
            return named[name][-1] if named.get(name) else 0

        for m in TOKEN.finditer(source):
            if m.start() > at and not dropped[stack[-1]]:
                parts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            if m[4] is None:
                continue
            name = m[4].lower()
            if m[3]:
                if name == "br":
                    parts.append((stack[-1], None))
                    continue
                depth = nearest(name)
                if depth and not (name in INLINE and borders[-1] > depth) and not (name == "p" and paragraph_borders[-1] > depth):
                    pop_to(depth)
                continue
            if name not in INLINE and name not in VOID or name == "hr":
                depth = nearest("p")
                if depth > max(borders[-1], paragraph_borders[-1]):
                    pop_to(depth)
            if name in CLOSES:
                border = {"tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",)}.get(name, ("ul", "ol", "dl", "menu"))
                above = max(nearest(b) for b in border)
                inside = [open_ones[bisect.bisect_right(open_ones, above)] for open_ones in (named.get(k) or [0] for k in CLOSES[name]) if open_ones[-1] > above]
                if inside:
                    pop_to(min(inside))
            node = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            dropped.append(dropped[stack[-1]] or self._is_dropped(name, m[5], articles > 0))
            self.end.append(node + 1)
            if name not in INLINE:
                parts.append((node, None))
            if name not in VOID and not m[5].endswith("/"):
                push(node, name)
        if at < len(source) and not dropped[stack[-1]]:
            parts.append((stack[-1], source[at:]))
        pop_to(1)
        self.end[0] = len(tag)

    def text(self, node: int) -> str:
        """Blocks of a subtree, joined by one space."""
        first, last, dropped = node, self.end[node], self.dropped
        pieces: list[str] = []
        for owner, piece in self.parts:
            if first <= owner < last:
                if piece is None:
                    pieces.append(" ")
                elif not dropped[owner]:
                    pieces.append(html.unescape(piece) if "&" in piece else piece)
        return " ".join("".join(pieces).split())

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of every node, and the sum over its children."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for owner, piece in self.parts:
            if piece is not None:
                size = len(" ".join(piece.split()))
                chars[owner] += size
                if in_link[owner]:
                    link_chars[owner] += size
        for i in range(n - 1, 0, -1):
            if self.dropped[i]:
                continue
            p = self.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        ratio = link_chars[0] / chars[0] if chars[0] else 0.0
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.dropped[i]:
                c, t, lc, lt = chars[i], tags[i] or 1, link_chars[i], link_tags[i] or 1
                base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
                density[i] = c / t * math.log(max(c / (lc or 1) * t / lt, 1.0)) / max(math.log(base), 1.0) if base > 1 else 0.0
        for i in range(1, n):
            total[self.parent[i]] += density[i]
        return density, total

    def _articles(self) -> list[int]:
        """Articles that lie in no other article."""
        out: list[int] = []
        for i, name in enumerate(self.tag):
            if name == "article" and not self.dropped[i] and (not out or i >= self.end[out[-1]]):
                out.append(i)
        return out

    def main_node(self) -> int:
        """Root of the article's subtree."""
        density, total = self.densities()
        n = len(self.tag)
        best = max(range(n), key=lambda i: (total[i], -i))
        path = [best]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        body = next((k for k, i in enumerate(path) if self.tag[i] == "body"), len(path) - 1)
        threshold = min(density[i] for i in path[: body + 1])
        article = max((k for k, i in enumerate(path) if self.tag[i] == "article"), default=None)
        limit = body if article is None else article
        # A short article can have less density than the page around it: descend to one that holds most of the text.
        articles = [i for i in self._articles() if best <= i < self.end[best]] if article is None else []
        if articles:
            size = [0] * (n + 1)
            for owner, piece in self.parts:
                if piece and not self.dropped[owner]:
                    size[owner + 1] += len(" ".join(piece.split()))
            size = list(itertools.accumulate(size))
            of = lambda i: size[self.end[i]] - size[i]
            largest = max(articles, key=of)
            if 2 * of(largest) >= of(best) > 0:
                return largest
        # The nearest step at which nothing beside the path is as dense as the threshold.
        children: dict[int, list[int]] = {}
        for i in range(1, n):
            if not self.dropped[i] and density[i] > 0:
                children.setdefault(self.parent[i], []).append(i)
        top = 0
        for k in range(limit):
            beside = [i for i in children.get(path[k + 1], ()) if i != path[k]]
            if any(density[i] >= threshold for i in beside):
                top = k + 1
        return path[top]


def main_text(source: str | None) -> str:
    """The article of a page."""
    if not source:
        return ""
    page = Page(source)
    text = page.text(page.main_node())
    if not text and len(page.tag) > 1:  # a wrapper with a name of one of the dropped parts
        page = Page(source, by_class=False)
        text = page.text(page.main_node())
    return text


def extract_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.column(whole.schema.names.index(source))
            for start, end in blocks(column):
                texts = [main_text(x) for x in pc.fill_null(column.slice(start, end - start), "").to_pylist()]
                yield appended(whole.slice(start, end - start), {"text": pa.array(texts, pa.string())})

    for_texts(pages.sparkSession)
    return pages.mapInArrow(run, schema_with(pages, {"text": T.StringType()}))
