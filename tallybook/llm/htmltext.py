"""Main text of web pages by text-to-tag ratios.

The parser's events are streamed into lines, one per block of the page: each line knows its text, how many
tags it holds, its nearest containers, and whether it stands inside something that is never content
(menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments). The
ratio of text to tags is smoothed over neighbouring lines by a Gaussian kernel. Lines fall into regions: an article,
the rest of a `main`, and elsewhere the nearest container. On every page the smoothed ratio chooses among them: a
region is content if one of its lines reaches the page's threshold, the ratios' standard deviation and a LEAST-th of
the best line at least. Structure is a prior on the ratio: on pages with an article or main, lines outside of them
count an OUTSIDE-th. What encloses a chosen article is chosen too. Every line of a chosen region that isn't excluded is
kept, so a short paragraph of an article is not lost. A class, id or role excludes by the last part of one of its names
(see `named`), but classes and ids never exclude an article, or a container with most of the page's text.

Character references are decoded, white space inside a block (line breaks too) becomes one space, blocks are
trimmed, empty ones dropped, and the rest joined in page order by a blank line. Null and empty pages give an
empty text, and so do pages without any content line. Broken markup is read as far as it goes: unclosed
elements end with their parent. Pages of any length are read whole, in pieces. Repeated rows are treated
alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices

SIGMA = 1.0      # of the Gaussian kernel, in lines
LEAST = 8.0      # parts of the best line's ratio that a region's best line must reach
OUTSIDE = 32.0   # times that a ratio outside of articles counts less, where a page has any
FEED = 1 << 20   # characters given to the parser at once

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
option p pre search section summary table tbody tfoot thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACING = frozenset("br td th img".split())
NEVER = frozenset("""aside button canvas dialog footer form head iframe menu nav noscript object script search
select style svg template textarea title""".split())
REGIONS = frozenset("article body div main section td".split())
CONTENT = frozenset(["article", "main"])
# words of class, id and role values that mark something else than the article
ASIDE = frozenset("""ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment
comments complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr login masthead menu
modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted
promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored
sponsors subscribe subscription taboola toolbar widget""".split())
REPLIES = frozenset("comment comments disqus replies respond".split())  # may well outweigh the article
# parts that say what a thing looks like or where it stands; what it is stands before them
SHAPES = frozenset("""area bar block body bottom box button buttons column container content cta form group header
holder icons inline inner item items left link links list main module outer panel posts primary right row secondary
section slot text title top unit wrap wrapper zone""".split())
STATES = frozenset("has is no not with without".split())  # first parts of names that tell a page's state
_WORDS = re.compile(r"[a-z0-9]+")
HARD = 1         # mark of what is excluded whatever it holds


def named(name: str) -> str | None:
    """The aside that a class or id names: the whole of it or its last part, but for numbers and SHAPES."""
    parts = [w for w in _WORDS.findall(name) if not w.isdigit()]
    if not parts or parts[0] in STATES:
        return None
    while len(parts) > 1 and parts[-1] in SHAPES:
        parts.pop()
    # every building block of some page builders is some-widget
    return parts[-1] if parts[-1] in ASIDE and (parts[-1] != "widget" or name == "widget") else None


class Lines(HTMLParser):
    """Collects lines (text, tags, region, inside article or main, mark) from parser events. Articles and mains that stand
    in neither are regions as a whole. A mark is 0, HARD, or the number of the innermost element that its class or id may
    exclude."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        # of each mark: the mark around it, and whether it holds replies
        self.marks: list[tuple[int, bool]] = [(0, False), (0, False)]
        self.text: list[str] = []
        self.tags = 0
        self.around = [0]  # of each region: the article or main around it, 0 if none
        # open elements: tag, mark, region, inside article or main
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, mark, region, content = self.open[-1]
            self.lines.append((text, self.tags, region, content, mark))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.end_implied(tag)
        elif tag in SPACING:
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        _, mark, region, content = self.open[-1]
        if mark != HARD:
            if tag in NEVER or (tag == "header" and not content) or self.barred(tag, attrs):
                mark = HARD
            elif asides := self.asides(tag, attrs):
                self.marks.append((mark, not REPLIES.isdisjoint(asides)))
                mark = len(self.marks) - 1
        if tag == "article" or (tag in REGIONS and not content):
            self.around.append(region if content else 0)
            region = len(self.around) - 1
        self.open.append((tag, mark, region, content or tag in CONTENT))

    @staticmethod
    def barred(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Hidden, or of a role that is never content."""
        if tag in ("html", "body", "main"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true"
                   or name == "role" and value and tag != "article" and not ASIDE.isdisjoint(value.lower().split())
                   for name, value in attrs)

    @staticmethod
    def asides(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
        if tag in ("html", "body", "main", "article"):
            return set()
        found = {named(n) for name, value in attrs if name in ("class", "id") and value for n in value.lower().split()}
        return found - {None}

    def excluded(self) -> list[bool]:
        """Of each line, whether it stands in something excluded."""
        held = [0] * len(self.marks)
        for text, _, _, _, mark in self.lines:
            held[mark] += len(text)
        whole = sum(held) - held[HARD]
        for k in range(len(held) - 1, HARD, -1):  # a mark's number is larger than that of the one around it
            held[self.marks[k][0]] += held[k]
        out = [False, True]
        for (around, replies), n in zip(self.marks[2:], held[2:]):
            out.append(out[around] or replies or 2 * n <= whole)
        return [out[mark] for *_, mark in self.lines]

    def end_implied(self, tag: str) -> None:
        """A new block ends an open paragraph, a new list item or row the open one."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == "p" or name in same.get(tag, ()):
                del self.open[k:]
                return
            if name in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACING:
            self.text.append(" ")
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return  # an inline end tag doesn't close blocks

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        _, mark, _, _ = self.open[-1]
        block = next((o for o in reversed(self.open) if o[0] in BLOCKS or not o[0]))
        if mark != block[1]:
            return  # an excluded inline element inside a block: only its own text goes
        self.text.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[reach:reach + len(ratio)]
    return np.convolve(ratio, kernel, "full")[reach:reach + len(ratio)] / weight


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines."""
    if not page:
        return ""
    parser = Lines()
    for start in range(0, len(page), FEED):
        parser.feed(page[start:start + FEED])
    parser.close()
    parser.flush()
    lines = parser.lines
    excluded = parser.excluded()
    if all(excluded):
        return ""
    allowed = ~np.array(excluded)
    ratio = np.array([len(text) / max(tags, 1) for text, tags, *_ in lines]) * allowed
    content = np.array([inside for _, _, _, inside, _ in lines])
    weight = np.where(content | ~(content & allowed).any(), 1.0, 1 / OUTSIDE)
    smooth = smoothed(ratio) * weight * allowed
    best = float(smooth.max())
    seeds = allowed & (smooth >= max(min(float(ratio.std()), best), best / LEAST))
    regions = {lines[k][2] for k in np.flatnonzero(seeds)}
    for region in list(regions):
        while region := parser.around[region]:
            regions.add(region)
    return "\n\n".join(line[0] for line, ok in zip(lines, allowed) if ok and line[2] in regions)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, 256):
            found = [main_text(h) for h in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(found, pa.string())],
                                             names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
