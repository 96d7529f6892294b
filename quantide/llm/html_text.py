"""Main text of web pages from parser events, text-to-tag ratios and clustering.

The page is streamed once through the standard library's event parser. Events cut
it into lines: runs of text between block-level tags, each with the number of tags
met in it, the share of its text inside links and the elements it stands in. A line's
text-to-tag ratio is its characters over its tags. The ratios, in page order, are
smoothed with a Gaussian kernel, and a threshold (the smoothed ratios' standard
deviation, at least ``floor``) splits lines in two clusters; runs of lines above it
are content regions. Regions are widened by distance, so that one-word paragraphs and
headings beside or between content lines are not lost: a line joins that lies between two lines of regions
in the same container, or at most ``BESIDE`` lines of that container before or after one. Only lines whose own ratio reaches
``floor`` widen a region, and a container with none of them holds none.
<article> and <main> are a hint for widening only: inside one that holds a region, lines
whose smoothed ratio reaches ``floor`` count as regions too (not those of another <article>
nested in it), and no distance is too large: a long run of short lines is the article's. An <article> without a region of its own adds
nothing, and lines outside are chosen by the same threshold: unmarked prose there
counts as content. What stands in menus, headers, footers, asides, forms, scripts, styles,
notices, adverts or reader comments, by tag, role, class or id, is no line at all. A class or id tells so only as
a whole: each of its words names such a part or is one of layout (``site-footer``, ``ad_box2``), as whole words. A name that merely
holds such a word (``share-price``, ``notice-of-meeting``) is a doubt: inside an article it says nothing, and elsewhere the element
goes unless most of the strongest region (by characters outside links) of all lines stands in it.

Defined results: a null or empty page, or one without content, gives an empty text;
malformed and cut-off markup is read as far as it goes, and a tag or comment that the page's end cuts off is no text; character references are
decoded, white space inside a line becomes one space, nothing else is dropped or
capped; pages are read one by one, so repeated rows get equal results; an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.llm.common import table

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is never content
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe svg math canvas object audio video button select textarea input label fieldset menu dialog head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: words of a class or id (cut at case changes and non-letters) that mark what isn't the article
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense adslot sponsor sponsors sponsored promo promos promotion promotions banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter newsletters subscribe subscription signup login comment comments commentlist commentform respond replies disqus share sharing social related recommended recommendations pagination paginator pager toolbar skip".split()
)
#: words of layout that may stand beside them
NEUTRAL = frozenset("site page main global top bottom left right center box bar block wrap wrapper container inner outer section area region panel pane row col column list item items link links icon icons button buttons form posts stories articles news content holder group slot unit zone module div primary secondary mobile desktop sticky fixed floating small large first last new to".split())
#: containers inside which a region is widened down to the lower threshold
HOLDERS = ("article", "main")
#: lines of a container that a region outside such elements takes in on either side of it
BESIDE = 5
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CUT_OFF = re.compile(r"<[A-Za-z/!?]")
_SPACE = re.compile(r"\s+")
#: blocks that are parts of a text, not containers of one
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption details summary center address hr".split())
#: closed by the start of another of their kind
_SELF_CLOSING = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def marked(attrs: list[tuple[str, str | None]], inside: bool = False) -> int:
    """2: the element isn't part of the article, 1: a class or id raises a doubt, 0: neither; ``inside``: it stands in one, where a header is a heading."""
    doubt = 0
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return 2
            continue
        if name in ("class", "id"):
            for named in value.split():
                words = [w.lower() for w in _WORD.findall(named)]
                marks = [w for w in words if w in MARKS and not (inside and w == "header")]
                if marks and all(w in MARKS or w in NEUTRAL for w in words):
                    return 2
                doubt |= bool(marks)
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return int(doubt)


Line = tuple[str, int, int, int, int, int]


class Lines(HTMLParser):
    """Collects lines: (text, tags, characters inside links, number of the innermost article or main, 0 if none, number of the container, number of the outermost doubtful element, 0 if none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool]] = []
        # where open blocks stand in the stack, how many elements of each tag are open, and how many inline ones in each open block
        self.blocks: list[int] = []
        self.open = Counter[str]()
        self.inline: list[Counter[str]] = [Counter()]
        self.containers: list[int] = [0]
        self.holders: list[int] = [0]
        # where the outermost doubtful element stands in the stack, and its number
        self.doubtful: tuple[int, int] | None = None
        self.opened = self.doubts = 0
        self.skipping = self.links = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.linked, self.holders[-1], self.containers[-1], self.doubtful[1] if self.doubtful else 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            self.tags += 1
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            if not self.skipping:
                self.flush()
            # an open element of the kinds that this one ends is closed
            if self.blocks and tag in _SELF_CLOSING.get(self.stack[self.blocks[-1]][0], ()):
                self.close_to(self.blocks[-1])
        # a header inside the article is its own heading
        mark = 0 if tag in ("html", "body", "article", "main") else marked(attrs, self.holders[-1] > 0)
        skip = tag in SKIPPED and not (tag == "header" and self.holders[-1]) or mark == 2
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        self.open[tag] += 1
        if mark == 1 and not self.doubtful and not self.holders[-1] and not self.skipping:
            if tag not in BLOCKS:
                self.flush()
            self.doubts += 1
            self.doubtful = (len(self.stack), self.doubts)
        self.stack.append((tag, skip))
        if self.is_container(tag):
            self.opened += 1
            self.containers.append(self.opened)
        self.skipping += skip
        self.tags += 1
        self.links += tag == "a"
        if tag in HOLDERS:
            self.holders.append(self.opened)

    @staticmethod
    def is_container(tag: str) -> bool:
        return tag in BLOCKS and tag not in _TEXTUAL

    def close_to(self, k: int) -> None:
        ends = self.doubtful is not None and self.doubtful[0] >= k
        if not self.skipping and (ends or any(t in BLOCKS for t, _ in self.stack[k:])):
            self.flush()
        if ends:
            self.doubtful = None
        for tag, skip in reversed(self.stack[k:]):
            self.open[tag] -= 1
            if tag in BLOCKS:
                self.blocks.pop()
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1
            self.skipping -= skip
            if self.is_container(tag):
                self.containers.pop()
            self.links -= tag == "a"
            if tag in HOLDERS:
                self.holders.pop()
        del self.stack[k:]
        if not self.skipping:
            self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        # a stray end of an inline element ends nothing outside its block
        if not (self.open[tag] if tag in BLOCKS or tag in SKIPPED else self.inline[-1][tag]):
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        self.close_to(k)

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at three sigmas and normed at the ends."""
    reach = int(math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def _regions(lines: list[Line], sigma: float, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's text-to-tag ratio, the smoothed one, and whether it stands in a content region."""
    ratio = np.array([max(0, len(t) - 2 * linked) / max(1, tags) for t, tags, linked, *_ in lines], dtype=float)
    smooth = smoothed(ratio, sigma)
    threshold = min(max(floor, float(smooth.std())), float(smooth.max()))
    return ratio, smooth, smooth >= threshold


def without_doubtful(lines: list[Line], sigma: float, floor: float) -> list[Line]:
    """Drops the lines of doubtful elements but of the one that holds most of the strongest region, if one does."""
    if not any(x[5] for x in lines):
        return lines
    core = _regions(lines, sigma, floor)[2]
    runs, run = [], []
    for x, up in [*zip(lines, core, strict=True), (None, False)]:
        if up:
            run.append(x)
        elif run:
            runs.append(run)
            run = []
    weight = Counter[int]()
    for t, _, linked, _, _, doubt in max(runs, key=lambda r: sum(len(x[0]) - x[2] for x in r)):
        weight[doubt] += len(t) - linked
    strongest = weight.most_common(1)[0][0]
    return [x for x in lines if x[5] in (0, strongest)]


def content(lines: list[Line], sigma: float = 1.0, floor: float = 10.0) -> list[str]:
    """The texts of the lines in content regions."""
    lines = without_doubtful(lines, sigma, floor)
    if not lines:
        return []
    ratio, smooth, core = _regions(lines, sigma, floor)
    # lines that are mostly links join no region
    menu = np.array([linked > (0.6 if holder else 0.5) * len(t) for t, _, linked, holder, *_ in lines])
    holders = {x[3] for x, up in zip(lines, core, strict=True) if up and x[3]}
    core = core | ~menu & (smooth >= floor) & np.array([x[3] in holders for x in lines])
    held = np.array([x[3] in holders for x in lines])
    # smoothing lifts lines beside a region: outside an article they neither widen it nor stand for a container of their own
    seeds = core & (held | (ratio >= floor))
    if not seeds.any():
        seeds = core  # a page of nothing but thin lines
    keep = core & held
    places: dict[int, list[int]] = {}
    for n, x in enumerate(lines):
        places.setdefault(x[4], []).append(n)
    for members in places.values():
        at = np.array(members)
        inside = np.flatnonzero(seeds[at])
        if len(inside):
            number = np.arange(len(at))
            reach = np.where(held[at], len(at), BESIDE)
            keep[at] |= core[at] | ~menu[at] & (number >= inside[0] - reach) & (number <= inside[-1] + reach)
    return [t for (t, *_), k in zip(lines, keep, strict=True) if k]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    # what the parser still waits to see the end of: markup that the page's end cuts off, or text
    if not _CUT_OFF.match(parser.rawdata):
        parser.close()
    parser.flush()
    return "\n\n".join(content(parser.lines))


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns with text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(html).alias("_html"), *keys).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, n_chars long")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
