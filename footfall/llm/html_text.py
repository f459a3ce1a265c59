"""Main text of web pages: text-to-tag ratios of lines, smoothed, clustered by a threshold.

The standard library's parser streams events. Every block-level tag ends a line, so that pages written on
one physical line have lines as well; each line counts its characters and tags. The ratios are smoothed
over neighbouring lines by a Gaussian kernel, and lines above a share of the standard deviation form the
content cluster. Elements that by their tag, role, class or id hold navigation, adverts, notices, forms,
comments and the like never take part; a class or id does not count where the element holds an article or
main element (of comments and links to other pages: the only ones), or most of the text of a page without
any. The content region is then every remaining line of all articles with clustered text, or else of a main
element, or else of the innermost element that holds half of the clustered text, so that short paragraphs
between long ones are kept whole, and of the elements beside it whose own lines are above the threshold.

Defined results: a null or empty page and one without text give an empty text; repeated rows are extracted
each; an empty table gives an empty table; other columns are ignored. Markup the parser refuses is read
with its tags stripped by pattern.
"""

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from footfall.llm.common import slices

# Fixed values of HTML: elements that end a line, have no end tag, or never hold main text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside audio button canvas dialog footer form head header iframe input label menu nav noscript object "
    "option script select style svg template textarea title video".split()
)
CONTAINERS = frozenset("article main section div td body".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsbygoogle|advert\w*|banner|breadcrumbs?|cookies?|consent|gdpr|comment\w*|replies|disqus|footer|header|masthead|"
    r"menu|nav|navbar|navigation|newsletter|notice|overlay|pagination|pager|popup|modal|promo\w*|related|recommend\w*|"
    r"share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|tags?|toolbar|widget|login|signup)(?:$|[\s_-])",
    re.IGNORECASE,
)
# Articles in these are no main text where the page has others.
OTHER_ARTICLES = re.compile(
    r"(?:^|\s)(?:comment\w*|replies|disqus|related|recommend\w*|sidebar|widget|promo\w*|sponsor\w*|ads?|advert\w*)(?:$|[\s_-])", re.IGNORECASE
)
_UNENDED = re.compile(r"<[!?/a-zA-Z]")
_TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.IGNORECASE | re.DOTALL)


class _Lines(HTMLParser):
    """Collects (text, tags, container) of each line outside dropped elements.

    Lines of an element dropped by its name are collected with its number, as the end of the page decides on it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self._lines: list[tuple[str, int, int, int]] = []  # with the element dropped by name, 0 outside any
        self.names: list[bool] = [False]  # by number of such an element: is it one of OTHER_ARTICLES
        self.within: list[int] = [0]  # the element dropped by name around it
        self.around: list[int] = [0]  # by container number: the element dropped by name around it
        self.kinds: list[str] = ["page"]  # by container number
        self.parents: list[int] = [0]
        self._open: list[tuple[str, bool, int, int]] = []  # tag, dropped, container, element dropped by name
        self._text: list[str] = []
        self._tags = 0

    def updatepos(self, i, j):
        """Line numbers, which nobody asks for here, cost a tenth of the parse."""
        return j

    def _place(self) -> tuple[bool, int, int]:
        return self._open[-1][1:] if self._open else (False, 0, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self._lines.append((text, self._tags, *self._place()[1:]))
        self._text, self._tags = [], 0

    def handle_starttag(self, tag, attrs):
        dropped, container, named = self._place()
        if tag in BLOCKS:
            self.end_line()
            if tag == "p" or tag == "li":
                self._close_in_block(tag)
                dropped, container, named = self._place()
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        if tag in DROPPED:
            dropped = True
        elif not dropped and (why := self._dropped_by(tag, attrs)):
            if why == "name":
                self.end_line()
                self.names.append(any(n in ("class", "id") and OTHER_ARTICLES.search(v or "") is not None for n, v in attrs))
                self.within.append(named)
                named = len(self.names) - 1
            else:
                dropped = True
        if tag in CONTAINERS:
            self.kinds.append(tag)
            self.parents.append(container)
            self.around.append(named)
            container = len(self.kinds) - 1
        self._open.append((tag, dropped, container, named))

    def _close_in_block(self, tag: str) -> None:
        """A paragraph or item that was never ended ends where the next one begins."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                return
            if self._open[k][0] in BLOCKS:
                return

    def _dropped_by(self, tag: str, attrs) -> str:
        """Whether an element is dropped: by its role, by its name (class or id), or not."""
        if tag in ("article", "main", "body", "html"):
            return ""
        named = ""
        for name, value in attrs:
            if value and name == "role" and value.lower() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return "role"
            if value and name in ("class", "id") and DROPPED_NAMES.search(value):
                named = "name"
        return named

    def lines(self) -> list[tuple[str, int, int]]:
        """The lines that count, with what is dropped by name and holds no main text left out."""
        if len(self.names) == 1:
            return [line[:3] for line in self._lines]

        def chain(number: int, up: list[int]) -> Iterator[int]:
            while number:
                yield number
                number = up[number]

        # Elements dropped by name that hold articles, and whether the page has articles that they do not hold.
        inside: dict[int, int] = {}
        total, articles = 0, False
        of_named: dict[int, int] = {}
        for text, _, container, named in self._lines:
            total += len(text)
            for n in chain(named, self.within):
                of_named[n] = of_named.get(n, 0) + len(text)
            top = [c for c in chain(container, self.parents) if self.kinds[c] in ("article", "main")]
            # Names outside of the article: those inside it hold no article of their own.
            for c in top:
                others = any(self.names[n] for n in chain(self.around[c], self.within))
                articles = articles or not others
                for n in chain(self.around[c], self.within):
                    inside[n] = inside.get(n, 0) + len(text)
        kept = {n for n in inside if not articles or not any(self.names[m] for m in chain(n, self.within))}
        if not articles and not inside:
            kept |= {n for n, size in of_named.items() if size * 2 > total}
        return [line[:3] for line in self._lines if all(n in kept for n in chain(line[3], self.within))]

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                if any(entry[3] != (self._open[k - 1][3] if k else 0) for entry in self._open[k:]):
                    self.end_line()
                del self._open[k:]
                break
            # An inline end tag does not close the blocks around it.
            if tag not in BLOCKS and self._open[k][0] in BLOCKS:
                break
        self._tags += 1

    def handle_data(self, data):
        if not self._place()[0]:
            self._text.append(data)


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="reflect" if len(values) > reach else "edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _above(parents: list[int], container: int) -> Iterator[int]:
    while container:
        container = parents[container]
        yield container


def main_text(html: str | None, sigma: float = 1.0, level: float = 0.5) -> str:
    """The text of a page's content region; `level` standard deviations of the ratio make the threshold."""
    if not html:
        return ""
    parser = _Lines()
    try:
        parser.feed(html)
        # Markup that never ends is no text.
        if not _UNENDED.match(parser.rawdata):
            parser.close()
        parser.end_line()
    except (AssertionError, ValueError):
        return " ".join(unescape(_TAG.sub(" ", html)).split())
    lines = parser.lines()
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    smooth = smoothed(ratios, sigma)
    content = smooth >= level * smooth.std()
    # Text of the cluster below each container, counted once for each of its ancestors.
    held: dict[int, int] = {}
    for (text, _, container), chosen in zip(lines, content):
        while chosen:
            held[container] = held.get(container, 0) + len(text)
            if not container:
                break
            container = parser.parents[container]
    total = held.get(0, 0)
    articles = {c for c in held if parser.kinds[c] == "article"}
    outer = [c for c in articles if not any(a in articles for a in _above(parser.parents, c))]
    mains = {c for c in held if parser.kinds[c] == "main" and held[c] * 4 >= total}
    beside: set[int] = set()
    if articles and sum(held[c] for c in outer) * 4 >= total:
        best = articles
    elif mains:
        best = mains
    else:
        best = {max((c for c in held if held[c] * 2 >= total), key=lambda c: (c, held[c]), default=0)}
        # Not for its neighbours only, as the smoothed ratio may be.
        above = content & (ratios >= level * smooth.std())
        beside = {line[2] for line, own in zip(lines, above) if own}
    chosen = []
    for text, _, own in lines:
        container = own
        while container and container not in best:
            container = parser.parents[container]
        if container in best or own in beside:
            chosen.append(text)
    return " ".join(chosen)


def extract(pages: DataFrame, sigma: float = 1.0, level: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(html, sigma, level) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()),
                    batch.column("url").cast(pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def html_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
