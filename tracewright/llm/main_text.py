"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and a threshold select the content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of HTML: elements without content, those that start a block of text, those that hold no reading text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNREAD = frozenset(
    "applet area aside audio button canvas datalist dialog embed fieldset footer form head iframe input label legend map menu nav noframes noscript object "
    "optgroup option script search select style svg template textarea title video".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What starts an element of the key's kind ends an open one, unless one of the value's is open inside.
ENDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",)}
ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",)}

#: Words of a class, an id or a role that mark what isn't the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead sidebar complementary widget related recommended recommendations "
    "footer contentinfo copyright cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social search form comment comments commentlist disqus discussion respond reply replies".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion respond reply replies".split())
#: Words that turn the next one round, as in has-sidebar, no-comments.
STATE_WORDS = frozenset("has with no without is can".split())
#: Words of a class or an id that mark the article, tried after the elements for it.
CONTENT_WORDS = frozenset("article articlebody content entry post story main maincontent".split())
UNFINISHED = re.compile("</?[a-zA-Z]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def name_words(value: str) -> set[str]:
    """Words of class names and ids, cut at - and _ and capitals; words behind one of STATE_WORDS are left out, as is that."""
    out: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        out.update(w for before, w in zip([None, *words], words) if before not in STATE_WORDS and w not in STATE_WORDS)
    return out


@dataclass
class Element:
    tag: str
    number: int
    aside: bool = False
    header: bool = False
    muted: bool = False
    rank: int = 0


@dataclass
class Line:
    """One block's text: its characters, those inside links, its tags, whether it may be content and the elements around it."""

    text: str
    linked: int
    tags: int
    wanted: bool
    path: tuple[int, ...] = field(repr=False)


class Lines(HTMLParser):
    """Turns parser events into lines, one for each stretch of text between the tags of block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: article elements, main elements and elements with a content name: how an element is marked as the article's
        self.ranks: dict[int, int] = {}
        self.open: list[Element] = []
        self.asides = self.headers = self.muted = self.count = self.tags = self.linked = 0
        self.link = False
        self.data: list[str] = []

    def updatepos(self, i: int, j: int) -> int:
        # line numbers aren't asked for
        return j

    def _line(self) -> None:
        if self.data and (text := " ".join("".join(self.data).split())):
            wanted = not self.asides and (not self.headers or (any(e.tag in HEADING for e in self.open) and any(e.rank == 1 for e in self.open)))
            self.lines.append(Line(text, min(self.linked, len(text)), self.tags, wanted, tuple(e.number for e in self.open)))
        if self.data:
            self.data = []
        self.tags = self.linked = 0

    def _leave(self, to: int) -> None:
        for element in self.open[to:]:
            self.asides -= element.aside
            self.headers -= element.header
            self.muted -= element.muted
        del self.open[to:]

    def _find(self, tags: tuple[str, ...], inside: tuple[str, ...] = ()) -> int | None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in inside:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            if not self.muted:
                self._line()
            # a block ends an open paragraph, an item the item before it
            if (at := self._find(("p",), ("td", "th", "table", "button"))) is not None:
                self._leave(at)
            if tag in ENDS and (at := self._find(ALIKE[tag], ENDS[tag])) is not None:
                self._leave(at)
        self.tags += 1
        if tag == "a":
            self.link = True
        if tag == "br":
            self.data.append(" ")
        if tag in VOID:
            return
        if not attrs and tag not in BLOCK and tag not in UNREAD and not self.asides:
            return
        element = Element(tag, self.count)
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style")}
        words = name_words(f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}") if named else set()
        marked = COMMENT_WORDS if tag in ("article", "main") else ASIDE_WORDS
        hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
        element.aside = tag in UNREAD or hidden or (tag not in ("html", "body") and not words.isdisjoint(marked))
        element.header = tag in ("header", "hgroup") or (tag not in ("html", "body", "article", "main") and "header" in words)
        if element.aside or element.header or tag in BLOCK or self.asides:
            self.count += 1
            # an aside inside a line is left out of it, and the line goes on behind
            element.muted = element.aside and tag not in BLOCK
            self.open.append(element)
            self.muted += element.muted
            self.asides += element.aside
            self.headers += element.header
            if tag == "article" or "articlebody" in named.get("itemprop", "").lower():
                element.rank = 1
            elif tag == "main" or named.get("role", "").lower() == "main":
                element.rank = 2
            elif tag in BLOCK and tag not in ("html", "body") and not words.isdisjoint(CONTENT_WORDS):
                element.rank = 3
            if element.rank:
                self.ranks[element.number] = element.rank

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # browsers read <div/> as <div>
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.muted:
            self._line()
        self.tags += 1
        if tag == "a":
            self.link = False
        if (at := self._find((tag,))) is not None:
            self._leave(at)
            if tag in BLOCK and not self.muted:
                self._line()

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        self.data.append(data)
        if self.link:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._leave(next((i for i, e in enumerate(self.open) if e.muted), len(self.open)))
        self._line()


@cache
def gaussian(sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    return np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """`ratio` under a Gaussian of `sigma` lines, weights adding up to one at the ends too."""
    kernel = gaussian(sigma)
    reach = len(kernel) // 2
    cut = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[cut] / np.convolve(np.ones(len(ratio)), kernel)[cut]


def content(parsed: Lines, sigma: float = 1.0) -> list[str]:
    """Lines of the regions whose smoothed text-to-tag ratio reaches its standard deviation, and of the element they make up."""
    lines = parsed.lines
    if not any(line.wanted for line in lines):
        return []
    ratio = smooth(np.array([len(line.text) / max(line.tags, 1) if line.wanted else 0.0 for line in lines]), sigma)
    least = ratio.std()
    chosen = [line.wanted and high for line, high in zip(lines, (ratio >= least).tolist())]
    total = sum(len(line.text) for line, c in zip(lines, chosen) if c)

    # the elements marked as the article's, if they hold half of the chosen text; the outermost of a kind count
    for rank in (1, 2, 3):
        outer = [next((n for n in line.path if parsed.ranks.get(n) == rank), None) for line in lines]
        held = {n for n, c in zip(outer, chosen) if c and n is not None}
        if 2 * sum(len(line.text) for line, n, c in zip(lines, outer, chosen) if c and n in held) >= total > 0:
            return [line.text for line, n in zip(lines, outer) if line.wanted and n in held]

    # else the innermost element with four fifths of it, and there what isn't mostly links or lies between chosen lines
    weight: dict[int, int] = {}
    for line, c in zip(lines, chosen):
        for n in line.path if c else ():
            weight[n] = weight.get(n, 0) + len(line.text)
    inner = max((n for n, w in weight.items() if 5 * w >= 4 * total), default=None)
    inside = [line.wanted and (inner is None or inner in line.path) for line in lines]
    at = [i for i, (c, here) in enumerate(zip(chosen, inside)) if c and here]
    return [line.text for i, (line, here) in enumerate(zip(lines, inside)) if here and (at[0] <= i <= at[-1] or 2 * line.linked <= len(line.text))]


def main_text(html: str, sigma: float = 1.0) -> str:
    # a tag that the end of the page cuts off is no text
    at = html.rfind("<")
    cut = at >= 0 and ">" not in html[at:] and UNFINISHED.match(html, at)
    parser = Lines()
    parser.feed(html[:at] if cut else html)
    parser.close()
    return "\n".join(content(parser, sigma))


def extract(pages: DataFrame, sigma: float = 1.0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of `pages`, blocks in page order joined by a line break.

    A block is the text between two tags of block elements, with references decoded
    and white space, of any kind Unicode has, turned into one space; a line break
    element is a space too. Menus, headers, footers, asides, adverts, notices, forms,
    scripts, styles, comments and hidden elements, known by their element, class, id
    or role, are never content, nor do they cut the block they stand in; of an article's
    own header its headings stay. Of the
    other blocks, those whose characters per tag, smoothed over `sigma` neighbouring
    blocks, reach the ratio's standard deviation tell where the content is. If it is
    in an article or main element, or one with such a name, the element's other
    blocks belong to it, short ones too; else those of the innermost element with
    four fifths of the chosen text that aren't mostly links.

    Null html, and html without such text, gives an empty text; text without any tag
    is one block. Unclosed and misnested elements end with the elements around them.
    Rows that repeat are taken one by one, null ids and addresses pass through, other
    columns aren't read. An empty table gives an empty result. A page is parsed whole
    in one task, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), sigma) for value in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    small_batches(pages)
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    return base.mapInArrow(run, f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, text string, n_chars long")
