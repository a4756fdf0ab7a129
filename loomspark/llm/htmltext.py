"""Main text of web pages by text-to-tag ratios.

A page streams through the standard library's parser once.  Its events make
lines (blocks of text) with the number of tags seen in each; the ratios are
smoothed with a Gaussian and split into two clusters, and the innermost box that
holds most of the content cluster is the region, widened to the article or main
element around it where there is one.  Elements and names that tell menus, headers,
footers, sidebars, notices, adverts, forms and reader comments lower the ratios of
their lines, and such lines do not come out of the region.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the Gaussian in lines, and how far it reaches.
SIGMA, REACH = 1.0, 3

# Element and name lists.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown as text of the page, and those that hold boilerplate.
_DROP = frozenset("button canvas head iframe math noscript object script select style svg template textarea title".split())
_ASIDE = frozenset("aside dialog footer form menu nav search".split())
_ENDS_P = _BLOCK - {"body", "html", "title", "option", "optgroup"}
#: An element of the first kind closes open ones of the second, up to the third.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation topnav breadcrumb breadcrumbs "
    "sidebar footer comment comments commentlist respond replies discussion disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended widget login signin signup search toolbar pagination pager copyright paywall".split()
)
#: Names that mark a page's head, yet are normal on the head of an article.
_HEADS = frozenset("header masthead topbar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WHOLE = frozenset("html body main article".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the ratio of a line is multiplied with: where it is boilerplate by element or name.
ASIDE = 0.1
#: Part of the content cluster's text that the region holds at least.
SHARE = 0.8
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


_DROPPED, _BESIDE = 1, 2


class Line:
    """A block of text and what is known of it; ``box`` is the number of the innermost block element around it."""

    __slots__ = ("parts", "tags", "linked", "box", "heading", "aside", "text", "ratio")

    def __init__(self, box: int, heading: bool, aside: bool, tags: int) -> None:
        self.parts: list[str] = []
        self.tags, self.linked, self.box, self.heading, self.aside = tags, 0, box, heading, aside
        self.text, self.ratio = "", 0.0


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # name, box, _DROPPED or _BESIDE or 0
        self.boxes: list[tuple[int, str]] = [(-1, "")]  # the box around and the name
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.open: Counter[str] = Counter()
        self.links = self.dropped = self.beside = self.article = self.headings = self.tags = 0

    def _break(self) -> None:
        if self.line is not None:
            self.lines.append(self.line)
            self.line = None
        self.tags = 0

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in _DROP:
            return _DROPPED
        if tag in _WHOLE:
            return 0
        kind = _BESIDE if tag in _ASIDE or tag == "header" and not self.article else 0
        for key, value in attrs:
            if key in ("class", "id"):
                words = {w.lower() for w in _SPLIT.split(value or "") if w}
                if words & _NAMES or (words & _HEADS and not self.article):
                    kind = _BESIDE
            elif key == "role" and (value or "").strip().lower() in _ROLES:
                kind = _BESIDE
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value or "", re.I)):
                return _DROPPED
        return kind

    def _count(self, tag: str, kind: int, by: int) -> None:
        self.dropped += by * (kind == _DROPPED)
        self.beside += by * (kind == _BESIDE)
        self.article += by * (tag in ("article", "main"))
        self.links += by * (tag == "a")
        self.open[tag] += by
        self.headings += by * (tag in _HEADING)

    def _pop(self, at: int) -> None:
        for name, _, kind in self.stack[at:]:
            self._count(name, kind, -1)
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._break()
        if tag in _ENDS_P:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    self._pop(k)
                    break
                if self.stack[k][0] in _BLOCK:
                    break
        if tag in _IMPLIED:
            closes, scope = _IMPLIED[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in scope:
                    break
                if self.stack[k][0] in closes:
                    self._pop(k)
                    if tag != "tr":
                        break
                    continue
        self.tags += 1
        if self.line is not None:
            self.line.tags += 1
        if tag in _VOID:
            if tag == "br" and self.line is not None:
                self.line.parts.append("\n")
            return
        kind = self._kind(tag, attrs)
        box = self.stack[-1][1] if self.stack else 0
        if tag in _BLOCK:
            self.boxes.append((box, tag))
            box = len(self.boxes) - 1
        self.stack.append((tag, box, kind))
        self._count(tag, kind, 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._break()
        elif self.line is not None:
            self.line.tags += 1
        for k in range(len(self.stack) - 1, -1, -1) if self.open[tag] else ():
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if self.stack[k][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                return  # a stray end tag does not close the article

    def handle_data(self, data: str) -> None:
        if self.dropped or (self.line is None and not data.strip()):
            return
        if self.line is None:
            self.line = Line(self.stack[-1][1] if self.stack else 0, self.headings > 0, self.beside > 0, self.tags)
        self.line.parts.append(data)
        if self.links:
            self.line.linked += len(data)


_OPEN_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")


def page_lines(html: str) -> tuple[list[Line], list[tuple[int, str]]]:
    """Lines of a page, in order, and its boxes, each after the one around it."""
    parser = _Events()
    parser.feed(_OPEN_TAG.sub("", html))  # a tag cut off at the end is markup, not text
    parser.close()
    parser._break()
    out = []
    for line in parser.lines:
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            line.ratio = (len(line.text) - min(line.linked, len(line.text))) / max(1, line.tags) * (ASIDE if line.aside else 1.0)
            out.append(line)
    return out, parser.boxes


_KERNEL = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-REACH, REACH + 1)]


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; beyond the ends the kernel is cut and scaled."""
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in zip(range(i - REACH, i + REACH + 1), _KERNEL, strict=True):
            if 0 <= k < len(ratios):
                total += w * ratios[k]
                weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The border of two clusters on the logarithm of the values (two-means, started at the extremes)."""
    logs = [math.log1p(v) for v in values]
    low, high = min(logs), max(logs)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in logs if v <= cut], [v for v in logs if v > cut]
        if not above:
            return -1.0
        a, b = sum(below) / len(below), sum(above) / len(above)
        if (a, b) == (low, high):
            break
        low, high = a, b
    return math.expm1((low + high) / 2) if high - low > math.log(2) else -1.0


def _linked(line: Line) -> bool:
    return 2 * line.linked > len(line.text)


def region(lines: list[Line], boxes: list[tuple[int, str]], content: list[bool]) -> list[int]:
    """The lines of the box that holds most of the content cluster."""
    weight = [0] * len(boxes)
    for x, good in zip(lines, content, strict=True):
        weight[x.box] += len(x.text) * good
    for n in range(len(boxes) - 1, 0, -1):
        weight[boxes[n][0]] += weight[n]
    chosen, depth = 0, [0] * len(boxes)
    for n in range(1, len(boxes)):
        depth[n] = depth[boxes[n][0]] + 1
        if weight[n] >= SHARE * weight[0] and depth[n] > depth[chosen]:
            chosen = n
    box = chosen
    while box > 0 and boxes[box][1] not in ("article", "main"):
        box = boxes[box][0]
    inner = [False] * len(boxes)
    for n in range(len(boxes)):
        inner[n] = n == (box or chosen) or (n > 0 and inner[boxes[n][0]])
    inside = [k for k, x in enumerate(lines) if inner[x.box]]
    if box:
        return inside
    # no element bounds the region: from its first content line, with the headings before it, to its last
    good = [k for k in inside if content[k]]
    first, last = good[0], good[-1]
    while first > 0 and lines[first - 1].heading and not lines[first - 1].linked and not lines[first - 1].aside:
        first -= 1
    return [k for k in range(first, last + 1) if (inner[lines[k].box] or k < good[0]) and not _linked(lines[k])]


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the article of a page."""
    lines, boxes = page_lines(html or "")
    if all(x.aside for x in lines):
        return []
    soft = smoothed([x.ratio for x in lines])
    cut = threshold(soft)
    content = [v > cut and not _linked(x) for v, x in zip(soft, lines, strict=True)]
    if not any(content):
        content = [not x.aside for x in lines]
    return [lines[k].text for k in region(lines, boxes, content) if not lines[k].aside]


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html, ...)``: ``page_id, url, text, n_chars``.

    Blocks are joined by an empty line.  Null or empty html, and pages without an
    article, give an empty text; repeated rows a row each; ids and urls are passed
    on as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                text = ["\n\n".join(main_blocks(h)) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
