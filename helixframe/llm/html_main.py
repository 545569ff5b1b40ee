"""Main text of HTML pages from streamed parser events.

The standard library's parser streams a page into blocks (runs of text between block-level tags).  Blocks inside
navigation, headers, footers, asides, forms, scripts, styles, notices, adverts and comment sections are set aside by their
tags and by class, id and role: a whole token that is a mark, or a compound that names such a part
(ad-box, cookie-notice, site-header), but not a wrapper that only mentions one (no-sidebar, has-header, with-comments).  Each remaining block has a text-to-tag ratio; the ratios are smoothed with
a Gaussian and split at a threshold, and the clusters above it decide, with their text:

* A mark that also begins ordinary names (share-price-report), and the mark of an element that is never closed, are evidence only:
  an element that holds most of the text of the high clusters stays, an unclosed one from its first high block to its last.
* If article and main elements hold most of that text, they are the container, otherwise the body.  Of several articles, one with
  less than a quarter of the longest one's text is a teaser and goes.
* In the body, low blocks next to each other that are links and nothing else are a menu and go.

Nothing else goes from the container.

Defined results: a null or empty page, or one without text outside of what is set aside, gives an empty text; unclosed
and stray tags never fail: a head ends where content begins, a block ends an open paragraph, and a form around an article or a
first heading is a wrapper; role main outweighs marks; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import slices

#: Elements whose text is never content.
DROP = frozenset("script style noscript template head title nav footer aside button select textarea option dialog iframe svg canvas object audio video map menu datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Whole tokens of class, id or role that mark what is not content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist disqus discussion replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "footer sitefooter header siteheader masthead topbar menu menus nav navbar navigation navigate sidebar sidebars sidenav aside widget widgets related recommended recommendations promo promos promotion promoted sponsor sponsored sponsors share sharing social "
    "newsletter subscribe subscription signup login search toolbar pagination pager copyright legal disclaimer skip tags tagcloud contentinfo complementary".split()
)
#: Marks that also stand in names of wrappers: in a compound they count only beside one of PLACES (before) or PIECES (after).
LAYOUT = frozenset("header sidebar sidebars aside footer nav navigation menu menus banner banners notice notices search skip legal disclaimer copyright overlay toolbar".split())
PLACES = frozenset("site page main top bottom left right global primary secondary mobile sub nav cookie cookies".split())
PIECES = frozenset("inner wrap wrapper container area bar box links list menu nav item items widget widgets top bottom link text".split())
#: Marks that begin names of ordinary content, too: such a compound is evidence that text outweighs, unless it goes on with one of PIECES.
MILD = frozenset("alert aside consent discussion legal promotion promotions recommended related replies search share sharing social subscription tags widget widgets".split())
#: What a head may hold, and what ends an open paragraph.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements whose end tag may be left out.
MAY_STAY_OPEN = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
#: How far a mark goes: none, evidence, or for certain.
NONE, EVIDENCE, CERTAIN = 0, 1, 2
#: Parts of a compound that say a page has or lacks something.
SAYS = frozenset("no not non has have with without is hide hidden show open enable enabled disable disabled".split())
#: Elements whose marks are ignored: a page or an article is never set aside as a whole.
WHOLE = frozenset(("html", "body", "article", "main"))
#: Elements that an opening tag of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


def names_mark(token: str) -> int:
    parts = WORDS.findall(token)
    if len(parts) < 2:
        return CERTAIN if parts and parts[0] in MARKS else NONE
    if not SAYS.isdisjoint(parts):
        return NONE
    first, last = parts[0], parts[-1]
    if first in MARKS and (first not in LAYOUT or parts[1] in PIECES):
        return EVIDENCE if first in MILD and parts[1] not in PIECES else CERTAIN
    return CERTAIN if last in MARKS and (last not in LAYOUT or first in PLACES) else NONE


def marked(attrs: list[tuple[str, str | None]]) -> int:
    strongest = NONE
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return CERTAIN
        if value and name in ("class", "id", "role"):
            tokens = value.lower().split()
            if name == "role" and "main" in tokens:
                return NONE
            for token in tokens:
                strongest = max(strongest, CERTAIN if token in MARKS else names_mark(token))
        elif value and name == "style" and "display:none" in value.replace(" ", "").lower():
            return CERTAIN
    return strongest


class Block(NamedTuple):
    text: str
    tags: int  # seen since the block before
    linked: int  # characters of links
    containers: tuple[int, ...]  # open article and main elements, outermost first
    marks: tuple[int, ...]  # open marked elements


class Events(HTMLParser):
    """Collects blocks.  Text of elements in DROP is not kept; whether a marked element goes is settled when the page has ended."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, dropped, number of the mark or 0
        self.dropped = 0
        self.links = 0
        self.containers: list[int] = []
        self.articles: set[int] = set()
        self.n_containers = 0
        self.marks: list[int] = []
        self.n_marks = 0
        self.mild: set[int] = set()
        self.unclosed: set[int] = set()
        self.forms: set[int] = set()
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0

    def end_block(self) -> None:
        if self.text:
            text = SPACES.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if text:
                self.blocks.append(Block(text, self.tags, self.linked, tuple(self.containers), tuple(self.marks)))
                self.tags = 0
            self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_block()
        if tag not in IN_HEAD and tag not in ("html", "head"):
            self.end_head()
        if tag in SELF_CLOSING:
            self.close_open(SELF_CLOSING[tag])
        elif tag in ENDS_P:
            self.close_open({"p"})
        if tag in VOID:
            return
        drop = tag in DROP or (tag == "header" and not self.containers)
        mark = marked(attrs) if attrs and tag not in WHOLE and not drop else NONE
        number = 0
        if mark or tag == "form":
            self.n_marks += 1
            number = self.n_marks
            self.marks.append(number)
            if tag == "form" and mark < CERTAIN:
                self.forms.add(number)
            elif mark == EVIDENCE:
                self.mild.add(number)
        self.open.append((tag, drop, number))
        self.dropped += drop
        self.links += tag == "a"
        if tag in ("article", "main"):
            self.n_containers += 1
            self.containers.append(self.n_containers)
            if tag == "article":
                self.articles.add(self.n_containers)
        if tag in ("article", "main", "h1") and self.forms:
            wrappers = self.forms.intersection(self.marks)
            self.forms -= wrappers
            self.marks = [m for m in self.marks if m not in wrappers]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_block()

    def end_head(self) -> None:
        """Content ends a head that was left open."""
        for i in range(len(self.open)):
            if self.open[i][0] == "head":
                while len(self.open) > i:
                    self.leave()
                return
            if self.open[i][0] != "html":
                return

    def close_open(self, kinds: set[str]) -> None:
        """Close an open element of these kinds if only inline elements stand above it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in kinds:
                while len(self.open) > i:
                    self.leave()
                return
            if self.open[i][0] not in INLINE:
                return

    def leave(self, closed: bool = False) -> None:
        tag, drop, number = self.open.pop()
        self.dropped -= drop
        self.links -= tag == "a"
        if number and number in self.marks:
            self.marks.remove(number)
            if not closed and tag not in MAY_STAY_OPEN and number not in self.forms:
                self.unclosed.add(number)
        if tag in ("article", "main"):
            self.containers.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i + 1:
                    self.leave()
                self.leave(True)
                return

    def handle_data(self, data: str) -> None:
        if self.dropped and self.open[-1][0] == "head" and not data.isspace():
            self.end_head()
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> list[Block]:
        self.close()
        self.end_block()
        while self.open:
            self.leave()
        return self.blocks


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and scaled."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(x, kernel)[r : r + len(x)]
    return full / np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]


def high_blocks(blocks: list[Block], sigma: float) -> np.ndarray:
    """Whether the smoothed text-to-tag ratio of each block reaches the mean."""
    ratio = smooth(np.array([len(b.text) / max(1, b.tags) for b in blocks]), sigma)
    return ratio >= min(ratio.mean(), ratio.max())


def unmarked(blocks: list[Block], mild: set[int], unclosed: set[int], sigma: float) -> list[Block]:
    """The blocks that no mark sets aside."""
    doubtful = mild | unclosed
    blocks = [b for b in blocks if doubtful.issuperset(b.marks)]
    if not any(b.marks for b in blocks):
        return blocks
    high = high_blocks(blocks, sigma)
    weight = np.where(high, [len(b.text) for b in blocks], 0)
    held: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        for m in b.marks:
            held.setdefault(m, []).append(k)
    gone = np.zeros(len(blocks), dtype=bool)
    for m, own in held.items():
        tall = [k for k in own if high[k]]
        if 2 * weight[own].sum() <= weight.sum():
            gone[own] = True
        elif m in unclosed:
            gone[[k for k in own if k < tall[0] or k > tall[-1]]] = True
    return [b for b, g in zip(blocks, gone, strict=True) if not g]


def content(blocks: list[Block], articles: set[int], sigma: float = 1.0) -> list[str]:
    """The texts of the content blocks, in page order."""
    if not blocks:
        return []
    high = high_blocks(blocks, sigma)
    weight = np.where(high, [len(b.text) for b in blocks], 0)
    inside = np.array([bool(b.containers) for b in blocks])
    if 2 * weight[inside].sum() >= weight.sum() and inside.any():
        # an article's blocks count for the outermost one
        own = [next((c for c in b.containers if c in articles), 0) for b in blocks]
        sizes: dict[int, int] = {}
        for k, c in enumerate(own):
            sizes[c] = sizes.get(c, 0) + len(blocks[k].text)
        most = max((n for c, n in sizes.items() if c), default=0)
        return [b.text for b, c in zip(blocks, own, strict=True) if b.containers and (not c or 4 * sizes[c] >= most)]
    link = ~high & np.array([b.linked >= len(b.text.replace(" ", "")) for b in blocks])
    beside = np.zeros(len(blocks), dtype=bool)
    beside[1:] |= link[:-1]
    beside[:-1] |= link[1:]
    return [b.text for b, menu in zip(blocks, link & beside, strict=True) if not menu]


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    events = Events()
    events.feed(html)
    blocks = unmarked(events.finish(), events.mild, events.unclosed, 1.0)
    return "\n".join(content(blocks, events.articles))


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with text and n_chars, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [extract(v.as_py()) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
