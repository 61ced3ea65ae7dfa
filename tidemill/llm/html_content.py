"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser reports tags and text as it reads. Each block of text (a
paragraph, heading, list item, cell, ...) is a line with the number of its characters and
of the tags since the block before. Lines are grouped by the container they stand in.

1. Lines inside elements that are furniture by tag, role or class name are no candidates,
   and neither are scripts, styles and the head. A class name is only a hint: it says nothing
   of the page and its article, and elements alike by name that hold most of the page's
   text, in dense lines, are no furniture where little dense text is left without them, unless
   they stand beside an article with text of its own. The same holds for a form.
2. The text-to-tag ratio of all lines, candidates or not, is smoothed with a Gaussian. The
   threshold is a share of its standard deviation, so it separates the page's own dense
   and sparse lines.
3. A container is content if most of its characters are in lines above the threshold, or if
   it stands in an article, and is not a list of links. All candidate lines of a content
   container are kept, short ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.stages import columns_or_null, prepared

SIGMA = 1.0
THRESHOLD = 0.5
LINKED = 0.6
#: Elements that a name makes furniture hold content if they have more than this share of the
#: text, and what is left without them less than that.
MOST, LITTLE = 0.5, 0.25
# Elements by what they mean for a page's text.
FURNITURE = frozenset(
    "head title script style noscript template svg math canvas object iframe audio video nav header footer aside "
    "form button select option textarea label fieldset dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "teaser comment comments disqus reply replies respond widget pagination pager toolbar copyright tags".split()
)
ARTICLE = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main table tbody thead tfoot ul ol dl blockquote center details".split())
BLOCKS = CONTAINERS | FURNITURE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre figure figcaption address hr summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand in a head, and those that no class makes furniture.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
WHOLE = frozenset("html body main article".split())
_WORD = re.compile(r"[a-z0-9]+")


def _furniture(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether tag, role or visibility make an element furniture."""
    if tag in FURNITURE and tag != "form":
        return True
    for name, value in attributes:
        if value and name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _named(tag: str, attributes: list[tuple[str, str | None]]) -> tuple | None:
    """What elements alike by a name that hints at furniture have in common."""
    words = [w for name, value in attributes if value and name in ("class", "id") for w in _WORD.findall(value.lower())]
    if tag == "form" or (tag not in WHOLE and not NAMES.isdisjoint(words)):
        return (tag, words[0] if words else "", *sorted(NAMES.intersection(words)))
    return None


class Lines(HTMLParser):
    """Collects ``(text, tags, linked characters, container, candidate, in article, names)``,
    where the names are those of :func:`_named` that the line stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool, frozenset]] = []
        self.open: list[tuple[str, bool, bool, int, frozenset]] = []  # tag, furniture, article, container, names
        self.state = (False, False, 0, frozenset())
        self.containers = 0
        self.text: list[str] = []
        self.tags = 0
        self.links = 0
        self.linked = 0

    def end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.state[2], not self.state[0], self.state[1], self.state[3]))
                self.tags = 0
            self.text.clear()
        self.linked = 0

    def leave_head(self, tag: str) -> None:
        """``</head>`` may be left out: what can't stand in a head ends it."""
        if tag == "body" or (tag not in IN_HEAD and self.open and self.open[-1][0] == "head"):
            depth = next((i for i, x in enumerate(self.open) if x[0] == "head"), None)
            if depth is not None:
                self.leave(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.leave_head(tag)
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if self.open and self.open[-1][0] in ("p", "li") and (tag == self.open[-1][0] or tag not in ("ul", "ol")):
                self.leave(len(self.open) - 1)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        furniture = _furniture(tag, attrs)
        named = None if furniture else _named(tag, attrs)
        if furniture or named or tag in CONTAINERS:
            if furniture or named:
                self.end_line()
            container = self.state[2]
            if tag in CONTAINERS:
                self.containers += 1
                container = self.containers
            self.open.append((tag, *self.state))
            names = self.state[3] | {named} if named else self.state[3]
            self.state = (self.state[0] or furniture, self.state[1] or tag in ARTICLE, container, names)

    def leave(self, depth: int) -> None:
        self.end_line()
        self.state = self.open[depth][1:]
        del self.open[depth:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self.end_line()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self.leave(depth)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.leave_head("")
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends there is nothing to weigh."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "same") if len(ratio) > 2 * reach else None
    if weight is None:
        n = np.arange(len(ratio))
        full = np.exp(-0.5 * ((n[:, None] - n) / sigma) ** 2) * (np.abs(n[:, None] - n) <= reach)
        return full @ ratio / full.sum(axis=1)
    return np.convolve(ratio, kernel, "same") / weight


def _candidates(lines: list[tuple], size: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Which lines can be content: not in furniture, or only in furniture by a name that the
    text speaks against."""
    sound = np.array([line[4] for line in lines])
    names = [line[6] for line in lines]
    article = np.array([line[5] for line in lines])
    text = size * sound
    solid = text * dense * np.array([line[2] <= LINKED * max(1, len(line[0])) for line in lines])
    of: dict[tuple, list[int]] = {}
    for i, own in enumerate(names):
        for name in own:
            of.setdefault(name, []).append(i)
    lifted: set[tuple] = set()
    free = np.array([not n for n in names])
    for name, at in sorted(of.items(), key=lambda x: (-text[x[1]].sum(), x[1][0], len(names[x[1][0]]))):
        if solid[free].sum() >= LITTLE * text.sum() or text[at].sum() <= MOST * text.sum():
            break
        beside = (text * free * article).sum() > 0 and not article[at].all()  # an article with its own text
        if not beside and solid[at].sum() > 0.5 * text[at].sum():
            lifted.add(name)
            free = np.array([n <= lifted for n in names])
    return sound & free


def content(html: str) -> str:
    """The main text of a page, one line for each block."""
    cut = html.rfind("<")
    if cut >= 0 and html.find(">", cut) < 0 and re.match(r"</?[A-Za-z!]|<$|</$", html[cut : cut + 3]):
        html = html[:cut]  # the page ends inside a tag
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(line[0]) for line in lines], float)
    ratio = smoothed(size / np.maximum(1, [line[1] for line in lines]))
    dense = ratio >= THRESHOLD * ratio.std()
    container = np.array([line[3] for line in lines])
    candidate = _candidates(lines, size, dense)
    _, of = np.unique(container, return_inverse=True)
    own = size * candidate
    linked = np.array([line[2] for line in lines], float) * candidate
    total = np.bincount(of, own)
    in_article = np.bincount(of, own * [line[5] for line in lines]) > 0
    many_links = np.bincount(of, linked) > LINKED * total
    good = (in_article | (np.bincount(of, own * dense) > 0.5 * total)) & ~many_links
    return "\n".join(line[0] for line, keep in zip(lines, candidate & good[of], strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [content(page) if page else "" for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` for every row of ``pages``: its main text, one line for each
    block, and the text's code points.

    NULL or empty html, and pages without content, give an empty text. Broken markup is
    read as far as it goes; a tag that the page ends in is dropped. NULL ids and URLs are
    kept, repeated rows give equal results, other columns are ignored, an empty table gives
    an empty result.
    """
    prepared(pages.sparkSession)
    rows = columns_or_null(pages, [(id_column, "long"), (url_column, "string"), (html_column, "string")])
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long")
