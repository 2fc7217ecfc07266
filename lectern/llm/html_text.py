"""Main text of HTML pages: text-to-tag ratio of each line, smoothed and clustered by a threshold.

Events of the standard library's streaming parser are turned into lines, one per block element.
Lines inside elements that are never text (scripts, forms) or that say what they are (menus,
headers, footers, sidebars, notices, adverts, reader comments) are set aside; a name or role on
pages without an article or main element says so only of an element that holds at most half of the
page's text without links, and reader comments and adverts also of larger ones unless nothing else
is left.  The ratio of characters to tags of the other lines is smoothed with a Gaussian; lines above
the standard deviation of the ratios form the content clusters.  The smallest element that holds
most of the clustered text is the content region and all its lines are the text; unless it is an
article or main element, link lists are left out (successive lines, at least half of them links,
with three links or more) and headings right before it are added.

Null and empty pages give an empty text.  Broken markup is read as browsers do: unknown end tags
are ignored, a new block closes an open paragraph, what is never closed ends with the page.
Repeated pages are extracted one by one; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import batches_of, only

# Element names of HTML, and words by which pages mark what is not their text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption tbody tfoot thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body caption head html legend optgroup option tbody tfoot thead title tr".split())
SPACED = frozenset("br td th img".split())
NEVER_TEXT = frozenset(
    "applet audio button canvas datalist dialog embed form head iframe input map math menu meter nav noscript object "
    "progress script select style svg template textarea title video search".split()
)
OUTSIDE = frozenset("aside footer".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
MARKS = re.compile(
    "(?:ads?|advert\\w*|adsense|adslot|adbox|banners?|sponsor\\w*|promo\\w*|nav\\w*|menus?|menubar|breadcrumbs?|side\\w*|aside|foot|footer\\w*|"
    "masthead|topbar|comment\\w*|repl(?:y|ies)|disqus|respond|cookies?|consent|gdpr|notices?|notification\\w*|alerts?|popups?|modal|overlay|"
    "subscri\\w*|newsletter\\w*|signup|login|share|sharing|social|related|recommend\\w*|widgets?|toolbar|pag(?:er|ination)|copyright|disclaimer|"
    "search|hidden|skip|outbrain|taboola)$"
)
COMMENTS = re.compile("(?:comment\\w*|repl(?:y|ies)|disqus|respond|advert\\w*|sponsor\\w*|promo\\w*)$")
HEADS = re.compile("(?:header\\w*|head)$")
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
REGIONS = ("article", "main")
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    path: tuple[int, ...]
    asides: tuple[int, ...]
    links: int = 0


@dataclass
class Element:
    tag: str
    number: int
    drops: bool
    aside: bool


@dataclass
class Reader(HTMLParser):
    """Collects lines with the elements they lie in."""

    lines: list[Line] = field(default_factory=list)
    tags_of: dict[int, str] = field(default_factory=dict)
    void_asides: set[int] = field(default_factory=set)
    named: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.count = self.dropping = self.tags = self.linked = self.links = self.anchors = 0
        self.text: list[str] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(e.number for e in self.open if e.tag in BLOCK)
            self.lines.append(Line(text, self.tags, self.linked, path, tuple(e.number for e in self.open if e.aside), self.anchors))
        if text or not self.text:
            self.tags = self.linked = self.anchors = 0
        self.text = []

    def _pop_to(self, at: int) -> None:
        for e in self.open[at:]:
            self.dropping -= e.drops
            self.links -= e.tag == "a"
        del self.open[at:]

    def _end_head(self) -> None:
        """What cannot lie in a head ends it."""
        if self.open and self.open[-1].tag == "head":
            self._pop_to(len(self.open) - 1)

    def _last(self, tags: frozenset[str] | tuple[str, ...], stop: frozenset[str] | tuple[str, ...] = ()) -> int | None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in IN_HEAD:
            self._end_head()
        if tag in SPACED:
            self.text.append(" ")
        if tag in BLOCK:
            self._end_line()
        if tag in VOID:
            return
        close = None
        if tag in ENDS_PARAGRAPH:
            close = self._last(("p",), ("article", "section", "div", "body", "table", "button"))
        if tag == "li":
            close = self._last(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close = self._last(("dt", "dd"), ("dl",))
        elif tag in ("tr", "td", "th"):
            close = self._last((tag,) if tag == "tr" else ("td", "th"), ("table",) if tag == "tr" else ("tr", "table"))
        elif tag == "body":
            close = self._last(("head",))
        if close is not None:
            self._pop_to(close)
        self.count += 1
        inside = self._last(REGIONS) is not None
        marks = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "style", "hidden", "aria-hidden")} if attrs else {}
        drops = tag in NEVER_TEXT or "hidden" in marks or marks.get("aria-hidden") == "true" or bool(UNSEEN.search(marks.get("style", "")))
        aside = tag in OUTSIDE or (tag == "header" and not inside) or marks.get("role", "") in ROLES
        if not aside and marks and tag not in ("html", "body"):
            words = [w.lower() for w in WORDS.findall(f"{marks.get('class', '')} {marks.get('id', '')}")]
            known = COMMENTS if tag in REGIONS else MARKS
            aside = any(known.match(w) or (not inside and tag not in REGIONS and HEADS.match(w)) for w in words)
            if aside and tag not in OUTSIDE:
                self.named[self.count] = any(COMMENTS.match(w) for w in words)
        elif aside and tag not in OUTSIDE and tag != "header":
            self.named[self.count] = False
        if tag in REGIONS and not aside:  # an element around an article is no menu, whatever its name
            self.void_asides.update(e.number for e in self.open if e.aside and e.tag not in OUTSIDE)
        self.open.append(Element(tag, self.count, drops, aside))
        self.tags_of[self.count] = tag
        self.dropping += drops
        self.links += tag == "a"
        self.anchors += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but void elements

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self._last((tag,))
        if tag in BLOCK:
            self._end_line()
        if tag in ("td", "th"):
            self.text.append(" ")
        if at is not None:
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.dropping:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        kept = [x for x in self.lines if not set(x.asides) - self.void_asides]
        if any(self.tags_of[n] in REGIONS for x in kept for n in x.path):
            return kept
        plain = [x for x in self.lines if not set(x.asides) - self.void_asides - self.named.keys()]
        weight: dict[int, int] = {}
        for x in plain:
            for number in x.asides:
                weight[number] = weight.get(number, 0) + max(0, len(x.text) - x.linked)
        half = sum(max(0, len(x.text) - x.linked) for x in plain) / 2
        wrappers = {n for n, comments in self.named.items() if not comments and weight.get(n, 0) > half}
        kept = [x for x in plain if not set(x.asides) - self.void_asides - wrappers]
        if not kept:  # all there is
            wrappers |= {n for n in self.named if weight.get(n, 0) > half}
            kept = [x for x in plain if not set(x.asides) - self.void_asides - wrappers]
        return kept


def smoothed(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian mean over ``radius`` lines to each side."""
    weights = [math.exp(-0.5 * (2 * k / (radius + 1)) ** 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + k]) for k, w in zip(range(-radius, radius + 1), weights) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_lines(lines: list[Line], tags_of: dict[int, str], share: float = 0.6) -> list[Line]:
    """The lines of the content region."""
    if not lines:
        return []
    ratio = smoothed([len(x.text) / max(1, x.tags) for x in lines])
    mean = sum(ratio) / len(ratio)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)), max(ratio))
    cluster = [r >= threshold for r in ratio]
    weight: dict[int, int] = {}
    for line, chosen in zip(lines, cluster):
        for number in line.path if chosen else ():
            weight[number] = weight.get(number, 0) + len(line.text)
    total = sum(len(x.text) for x, chosen in zip(lines, cluster) if chosen)
    holds = [n for n, w in weight.items() if w >= share * total]
    marked = [n for n in holds if tags_of[n] in REGIONS]
    if marked:
        region = max(marked)
        return [x for x in lines if region in x.path]
    wide = [n for n in holds if tags_of[n] not in ("p", "li", "blockquote", "pre")]
    region = max(wide, default=None)
    inside = [region is None or region in x.path for x in lines]
    first = inside.index(True)
    heading = {"h1", "h2", "h3"}
    while first and tags_of.get(lines[first - 1].path[-1] if lines[first - 1].path else 0) in heading:
        first -= 1
        inside[first] = True
    return without_link_lists([x for x, kept in zip(lines, inside) if kept])


def without_link_lists(lines: list[Line], least: int = 3) -> list[Line]:
    """The lines but for runs of lines that are mostly links, with ``least`` links or more."""
    out: list[Line] = []
    for listed, run in groupby(lines, lambda x: 2 * x.linked > len(x.text)):
        found = list(run)
        if not listed or sum(x.links for x in found) < least:
            out += found
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    html = html.replace("<![", "<!")
    reader.feed(html + "-->" if html.rfind("<!--") > html.rfind("-->") else html)
    return "\n".join(x.text for x in content_lines(reader.finish(), reader.tags_of))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 512):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return only(pages, page_id="page_id", url="url", html="html").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
