"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing and a threshold.

The standard library's parser streams events into lines: a line is the text between two borders of block elements. An unwanted element within a line
is left out of it and does not cut it; the words of a label or button in a paragraph are its own. Elements that
are never article text (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden
parts), known by their tag, role, class or id, give no lines. A class or id counts as a whole: "sidebar" or "site-nav", but not "with-sidebar" or
"comments-open"; and it does not count against an element that holds most of the content, unless an article or main element beside it has content.
A line's ratio is its text outside links by its tags. The ratios are smoothed
with a Gaussian, and lines above the threshold (the smoothed ratios' deviation, but not over their mean) are clustered as content. The region is
the deepest element that holds all of that text, widened to the outermost article or main element around it; the text is every line of the region,
so short headings, paragraphs and lists of links in the article stay.

Character references are decoded, white space within a line becomes one space, lines are joined by a newline. Null, empty and
text-free pages give an empty text. The work on a page is linear in its length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.common import as_text, map_texts

SIGMA = 1.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main"
    " menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_REGION = frozenset("article main section div td body center".split())
_NEVER = frozenset(
    "head script style noscript template svg math canvas object embed iframe audio video map nav aside footer menu dialog form button select option textarea input label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead footer sidebar sidebars rail widget widgets ad ads advert adverts advertisement advertising adsense banner promo promotion"
    " sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations"
    " comment comments commentlist reply replies respond disqus discussion pagination pager skip toolbar paywall".split())
#: Names that mean the page's own head or foot, unless an article holds them.
_HEADS = frozenset("header topbar".split())
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Parts that may stand beside a name and leave its meaning; with any other part ("with", "no", "category", "open") the class means something else.
_BESIDE = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer mobile desktop container wrapper wrap holder box bar block area list item items links link buttons button"
    " icons section group panel row column col posts thread form inline fixed sticky the js".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CLOSED_BY_BLOCK = frozenset(["p"])
#: Form elements whose words, in a paragraph, are words of the paragraph.
_WORDED = frozenset(["button", "label"])
_ITEMS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def _never(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in _NEVER:
        return True
    if tag == "header" and not in_article:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true":
            return True
        if name == "role" and (value or "").lower() in _ROLES:
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """1 if a class or the id names something other than article text, 2 if reader comments, else 0."""
    found = 0
    for name, value in attrs if tag not in ("html", "body", "main") else ():
        for token in value.split() if name in ("class", "id") and value else ():
            parts = {p.lower() for p in _PARTS.findall(token)}
            named = parts & _NAMES if in_article else parts & (_NAMES | _HEADS)
            if named and parts - named <= _BESIDE:
                found = max(found, 1 if named.isdisjoint(_COMMENTS) else 2)
    return found


class Lines(HTMLParser):
    """Turns events into lines: (text, characters outside links, tags, innermost region, text as it stands, block).

    A block is one line, or several where a named element within it makes a region of its own.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # open elements, each with its region or -1
        self.open: list[int] = []  # regions, innermost last
        self.regions: list[tuple[str, int]] = [("body", -1)]  # tag and parent of each region
        self.named: dict[int, int] = {}  # regions that by their name are no article text
        self.never = 0  # depth in the stack at which the outermost unwanted element stands, plus one
        self.links = self.articles = 0
        self.lines: list[tuple[str, int, int, int, str, int]] = []
        self.parts: list[str] = []
        self.plain = self.tags = self.block = 0

    def cut(self, border: bool = True) -> None:
        """End a line; ``border`` ends its block too. Nothing ends within an unwanted element."""
        if self.never:
            return
        raw = "".join(self.parts)
        text = " ".join(raw.split())
        if text:
            self.lines.append((text, self.plain, self.tags, self.open[-1] if self.open else 0, raw, self.block))
        if text or border:
            self.parts = []
        self.plain = self.tags = 0
        self.block += border

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        around = max(0, self.never - 1)  # what opens in an unwanted element closes nothing around it
        if tag in _BLOCK:
            self.close_to(_CLOSED_BY_BLOCK, ("body", "article", "section", "div", "td", "th", "li", "table", "button", "object"), around)
            self.cut()
        if tag in _ITEMS:
            self.close_to((tag,) if tag not in ("dt", "dd", "td", "th") else ("dt", "dd") if tag in ("dt", "dd") else ("td", "th"), _ITEMS[tag], around)
        self.tags += not self.never
        if tag in _VOID:
            if tag == "br" and not self.never:
                self.parts.append(" ")
            return
        worded = tag in _WORDED and any(t == "p" for t, _ in self.stack)
        if not self.never and not worded and _never(tag, attrs, self.articles > 0):
            self.never = len(self.stack) + 1
        region = -1
        named = 0 if self.never else _named(tag, attrs, self.articles > 0)
        if (tag in _REGION or named) and not self.never:
            region = len(self.regions)
            if named:
                self.cut(tag in _BLOCK)
                self.named[region] = named
            self.regions.append((tag, self.open[-1] if self.open else 0))
            self.open.append(region)
        self.stack.append((tag, region))
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("svg", "math"):  # elsewhere the slash means nothing
            self.handle_starttag(tag, attrs)

    def close_to(self, tags: tuple[str, ...] | frozenset[str], walls: tuple[str, ...], lowest: int = 0) -> None:
        """Close the nearest open element among ``tags``, unless one of ``walls`` stands before it or it stands below ``lowest``."""
        for i in range(len(self.stack) - 1, lowest - 1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self.pop(i)
                return
            if tag in walls:
                return

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, region = self.stack.pop()
            if tag in _BLOCK or region >= 0:
                self.cut(tag in _BLOCK)
            if region >= 0:
                self.open.pop()
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")
            if self.never > len(self.stack):
                self.never = 0

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.never
        if tag in _VOID:
            return
        if tag in _BLOCK:
            self.cut()
        walls = () if tag in ("body", "html") or tag in _REGION else ("article", "main", "section", "div", "td", "th", "body", "nav", "footer", "header", "aside", "form")
        self.close_to((tag,), walls)

    def handle_data(self, data: str) -> None:
        if self.never:
            return
        self.parts.append(data)
        if not self.links:
            self.plain += len(data) - data.count(" ")


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.concatenate([np.full(reach, x[0]), x, np.full(reach, x[-1])])
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _content(lines: list[tuple[str, int, int, int, str, int]]) -> list[tuple[int, int]]:
    """(region, characters) of the lines above the threshold. Only lines of links are looked at if there are no others."""
    lines = [x for x in lines if x[1] > 0] or [(x[0], len(x[0]), *x[2:]) for x in lines]
    ratio = smoothed(np.array([x[1] / max(1, x[2]) for x in lines]))
    return [(x[3], x[1]) for x, on in zip(lines, ratio >= min(ratio.std(), ratio.mean())) if on]


def _mass(regions: list[tuple[str, int]], content: list[tuple[int, int]], walls: set[int] | frozenset[int] = frozenset()) -> list[int]:
    """Characters of content in each region, those within the regions of ``walls`` counted there only."""
    mass = [0] * len(regions)
    for r, n in content:
        mass[r] += n
    for r in range(len(mass) - 1, 0, -1):  # children come after their parents
        if r not in walls:
            mass[regions[r][1]] += mass[r]
    return mass


def _within(regions: list[tuple[str, int]], tops: set[int]) -> list[bool]:
    inside = [False] * len(regions)
    for r in range(len(regions)):
        inside[r] = r in tops or r > 0 and inside[regions[r][1]]
    return inside


def _unwanted(regions: list[tuple[str, int]], named: dict[int, int], lines: list[tuple[str, int, int, int, str, int]]) -> list[bool]:
    """Regions in an element that goes by its name. One that holds most of the content stays if no article or main element beside it has content.

    For reader comments the article or main element around them counts too.
    """
    content = _content(lines)
    mass = _mass(regions, content)
    walls = set(named)
    for kind in (1, 2):
        most = {r for r in walls if named[r] == kind and 2 * mass[r] > mass[0]}  # one in the other, if several
        if most:
            own, lost = _mass(regions, content, walls), _within(regions, walls)
            around = set()
            up = max(most) if kind == 1 else -1
            while up >= 0:
                around.add(up)
                up = regions[up][1]
            if not any(own[r] and not lost[r] and r not in around for r, (tag, _) in enumerate(regions) if tag in ("article", "main")):
                walls -= most
    return _within(regions, walls)


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.pop(0)
    parser.cut()
    lines, regions = parser.lines, parser.regions
    if lines and parser.named:
        lost = _unwanted(regions, parser.named, lines)
        lines = [x for x in lines if not lost[x[3]]]
    if not lines:
        return ""
    mass = _mass(regions, _content(lines))
    region = max(r for r in range(len(mass)) if mass[r] == mass[0])
    up = region
    while up >= 0:
        if regions[up][0] in ("article", "main"):
            region = up
        up = regions[up][1]
    inside = _within(regions, {region})
    kept = groupby((x for x in lines if inside[x[3]]), key=lambda x: x[5])
    return "\n".join(" ".join("".join(x[4] for x in block).split()) for _, block in kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to every page; the markup column is dropped."""
    def make(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in as_text(batch, html_col)]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_texts(pages, make, "text string, n_chars long", html_col, (html_col,))
