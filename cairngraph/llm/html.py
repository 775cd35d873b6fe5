"""Content extraction from HTML by text-to-tag ratios.

The standard library's parser streams events; its events are cut into lines at block tags and at line ends of the
source; each line has a ratio of its text's characters to its tags; the ratios are smoothed by a Gaussian and lines
above a threshold, clustered with their neighbours, are content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm._shared import tune

#: Standard deviation of the kernel in lines (it reaches 3 of them); share of the ratios' deviation that a line must reach;
#: lines below it that may lie between two lines of one cluster.
SIGMA, SHARE, GAP = 1.0, 1.0, 3
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
_SKIPPED = frozenset("script style noscript template head nav footer aside select button svg iframe".split())
#: What a head may hold, any other tag ends it; skipped elements whose text counts if they have no end of their own.
_IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
_LAYOUT = frozenset("nav footer aside select button".split())
_BLANKS = re.compile(r"\s+")


class LineParser(HTMLParser):
    """Gathers (text, tags) lines; text inside skipped elements doesn't count, their tags do.

    ``shown`` are the numbers of the skipped elements whose text counts all the same; ``unclosed`` gathers those that
    another element's end or the page's ends.
    """

    def __init__(self, shown: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.shown, self.unclosed = shown, set()
        self.seen = 0
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.parts: list[str] = []
        self.count = 0
        self.hidden: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()  # of the hidden ones, by name

    # What has no end is text from its "<" on, and never searched for its end again: broken mark-up takes linear time.

    def goahead(self, end: bool) -> None:
        self.last_end, self.last_comment_end = self.rawdata.rfind(">"), self.rawdata.rfind("-->")
        super().goahead(end)

    def _bare(self, i: int, size: int = 1) -> int:
        self.handle_data(self.rawdata[i : i + size])
        return i + size

    def parse_starttag(self, i: int) -> int:
        return super().parse_starttag(i) if i < self.last_end else self._bare(i)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if i < self.last_end else self._bare(i)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if i < self.last_end else self._bare(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return super().parse_comment(i, report) if i < self.last_comment_end else self._bare(i, 4)

    def parse_html_declaration(self, i: int) -> int:
        if i > self.last_end:
            return self._bare(i)
        return self.parse_bogus_comment(i) if self.rawdata[i : i + 3] == "<![" else super().parse_html_declaration(i)

    def hide(self, tag: str) -> None:
        self.hidden.append((tag, self.seen))
        self.open[tag] += 1

    def show(self) -> tuple[str, int]:
        top = self.hidden.pop()
        self.open[top[0]] -= 1
        return top

    def line(self) -> None:
        if self.parts or self.count:
            self.texts.append("".join(self.parts))
            self.tags.append(self.count)
            self.parts, self.count = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden and self.hidden[-1][0] == "head" and tag not in _IN_HEAD:
            self.show()
        if tag in _BLOCK:
            self.line()
        self.count += 1
        if tag in _SKIPPED:
            self.seen += 1
            if self.seen not in self.shown:
                self.hide(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.line()
        self.count += 1

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if self.open[tag]:
            while (top := self.show())[0] != tag:
                self.unclosed.add(top)
        if tag in _BLOCK:
            self.line()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if "\n" in data:
            first, *rest = data.split("\n")
            self.parts.append(first)
            for part in rest:
                self.line()
                if part:
                    self.parts.append(part)
        else:
            self.parts.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a normalised Gaussian; the edges repeat the outermost value."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def content_lines(texts: list[str], tags: list[int], sigma: float = SIGMA, share: float = SHARE) -> list[str]:
    """The lines of content: those whose smoothed ratio reaches ``share`` of its deviation, what lies between two of
    them that are at most GAP lines apart, and lines next to such a cluster whose own ratio reaches it."""
    if not texts:
        return []
    ratio = np.array([len(t) for t in texts], float) / np.maximum(1, np.array(tags))
    even = smooth(ratio, sigma)
    threshold = share * float(even.std())
    kept = (even >= threshold) & (even > 0)
    core = np.flatnonzero(kept)
    for a, b in zip(core[:-1], core[1:], strict=True):
        if b - a <= GAP + 1:
            kept[a:b] = True
    strong = ratio >= threshold
    for order in (range(1, len(texts)), range(len(texts) - 2, -1, -1)):
        for i in order:
            kept[i] |= strong[i] and kept[i - order.step]
    return [t for t, k in zip(texts, kept, strict=True) if k]


def _parsed(html: str, shown: frozenset[int] = frozenset()) -> LineParser:
    parser = LineParser(shown)
    parser.feed(html)
    parser.close()
    parser.line()
    return parser


def extract(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> tuple[str, int, int]:
    """(content, lines of text, lines kept) of one page."""
    parser = _parsed(html or "")
    if shown := frozenset(n for t, n in parser.unclosed.union(parser.hidden) if t in _LAYOUT):
        parser = _parsed(html or "", shown)
    texts = [_BLANKS.sub(" ", t).strip() for t in parser.texts]
    # a line without text only adds its tags to the next one, so that deep nesting doesn't thin out the text
    lines, tags, waiting = [], [], 0
    for t, n in zip(texts, parser.tags, strict=True):
        if t:
            lines.append(t)
            tags.append(n + waiting)
            waiting = 0
        else:
            waiting += n
    kept = content_lines(lines, tags, sigma, share)
    return "\n".join(kept), len(lines), len(kept)


def extract_pages(pages: DataFrame, sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """(page_id, content, n_lines, n_kept) of every page.

    Defined results: null, empty or tagless HTML: the text itself, if any, else an empty content; a null page_id stays
    null; repeated rows give equal rows; very long pages are read whole, in linear time; a tag or comment without an end
    is text, an element without an end hides nothing unless it is a script or the like; a page of equal ratios, as of one
    line, is content; an empty table gives no rows; other columns are not read.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(h, sigma, share) for h in batch.column(1).to_pylist()]
            c = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32())], names=["page_id", "content", "n_lines", "n_kept"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, content string, n_lines int, n_kept int")
