"""Main text of web pages by text-to-tag ratio.

A page's parser events are cut into lines: runs of text between block-level tags. Each line has
a text-to-tag ratio, its characters over the tags met in it. The ratios are smoothed with a
Gaussian over neighbouring lines, and lines at or above one standard deviation are the cluster
of content. The content region is the innermost element that holds nine tenths of that cluster's text;
in an ``article`` or ``main`` element it is the whole of it, since an article's short lines are
content too, and so it is in any box; in the body it runs from the first line of the cluster, with
the headings right above, to the end. Scripts, styles, controls and elements that are not shown are left out with all they
hold. Elements that mark themselves as navigation, header, footer, sidebar, notice, advert, form or
reader comments, by name, role or class, are weighed: they are left out unless they wrap the page's
content. A class name or a form does where it is around a main element, the only articles, or,
where no article stands outside it, nearly all text outside links; ``nav``, ``aside``, ``footer`` and their like where a main element
is inside, or where their end tag is missing and they swallowed the only articles or most of the
text. A class or id marks its element if all its words say so (``comments``, ``ad-banner``,
``related-posts``, not ``ad-hoc-query`` or ``related-work``), and a header that belongs to an article
(inside one, or named ``post-header``) is its title; names that tell a state (``has-sidebar``,
``with-menu``) mark nothing. Inline elements stand in the middle of sentences and are never set
aside for their names.

An element covers consecutive lines, so it is kept as a range of them: memory and time follow the
page's length, however deep its elements are nested.

Defined cases: null, empty or text-free html gives ''; broken or unclosed tags and malformed
declarations never fail (an end tag without its start is skipped, a declaration that the parser
does not know is a comment); repeated pages give equal rows; whole pages are read, however long.
Only the named column is read, other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol "
    "option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset("head title script style noscript template iframe svg canvas object button select textarea option dialog".split())
BESIDE = frozenset("nav aside footer menu".split())
BOXES = frozenset("article main section div td body".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "option"}
# Words by which elements name themselves as something else than content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer comment comments reply replies respond disqus social share sharing related recommended newsletter "
    "subscribe subscription signup login search pagination pager toolbar widget widgets skip".split()
)
#: Words that may stand beside a mark without giving the name another meaning.
BESIDE_MARKS = frozenset(
    "area bar block body bottom box btn button buttons center col column container content form global group holder "
    "icons inner item items layer left link links list main message news outer page panel place primary right row "
    "secondary section site slot space stories text thread top trail unit user wrap wrapper zone".split()
)
#: Words for an article: a header of that name is its title.
ARTICLE_WORDS = frozenset("article articles blog entry post posts story".split())
TITLES = frozenset("header masthead banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: After these words a class name tells what the page has, not what the element is.
STATES = frozenset("has with no without".split())
#: Elements whose names say that they hold the content whatever their classes are.
WHOLE = frozenset(("html", "body", "main", "article"))


def _names_itself(value: str, within: bool) -> bool:
    """Whether a class or id names its element as something else than content.

    within: it stands inside an article or main element.
    """
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        tokens = set()
        for token in re.split(r"[^a-z0-9]+", name):
            if token in STATES:
                break
            if token and not token.isdigit():
                tokens.add(token)
        marks = tokens & MARKS
        if not marks or tokens - MARKS - BESIDE_MARKS - ARTICLE_WORDS:
            continue
        if marks - TITLES or not (within or tokens & ARTICLE_WORDS):
            return True
    return False


def _role_of(tag: str, attrs: list, within: bool) -> str:
    """What an element is by itself: 'hidden', 'beside' the content, 'marked' as something else, or ''.

    within: it stands inside an article or main element.
    """
    if tag in HIDDEN:
        return "hidden"
    found = "beside" if tag in BESIDE or (tag == "header" and not within) else "marked" if tag == "form" else ""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value and value.lower() == "true"):
            return "hidden"
        if not value or tag in WHOLE:
            continue
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return "hidden"
        if name == "role" and value.lower() in ROLES:
            found = "beside"
        if name in ("class", "id") and not found and _names_itself(value, within):
            found = "marked"
    return found if tag in BLOCKS else ""


@dataclass
class _Element:
    """The lines, articles and main elements that begin inside an element, as ranges."""

    tag: str
    role: str
    lines: tuple[int, int]
    articles: tuple[int, int]
    mains: tuple[int, int]
    closed: bool = False  # by its own end tag


class _Page(HTMLParser):
    """Collects a page's lines, and the elements around them that can hold content or be set aside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, _Element | None]] = []
        self.count: Counter = Counter()  # open elements by name
        self.hidden = 0
        self.hidden_blocks = 0
        self.articles = 0
        self.mains = 0
        self.boxes: list[_Element] = []
        self.weighed: list[_Element] = []
        self.parts: list[str] = []
        self.tags = 0
        self.dropped = False  # text since the last line was hidden
        self.plain_now = 0
        # Of each line: its text, the tags met in it, its characters outside links, whether it is a heading.
        self.texts: list[str] = []
        self.n_tags: list[int] = []
        self.plain: list[int] = []
        self.heading: list[bool] = []

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.texts.append(text)
            self.n_tags.append(self.tags)
            self.plain.append(self.plain_now)
            self.heading.append(any(self.count[h] for h in HEADINGS))
        if text or self.dropped:
            self.tags = 0
        self.plain_now, self.dropped = 0, False
        self.parts.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and any(name == "p" for name, *_ in self.open[-8:]):
            self._close("p")
        if tag in ("li", "dd", "dt", "tr", "td", "th") and self.open and self.open[-1][0] == tag:
            self._close(tag)
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        role = _role_of(tag, attrs, bool(self.count["article"] or self.count["main"]))
        element = None
        if not self.hidden and (role in ("beside", "marked") or tag in BOXES):
            element = _Element(tag, role, (len(self.texts), -1), (self.articles, -1), (self.mains, -1))
            (self.weighed if role else self.boxes).append(element)
            if role and tag in BOXES:
                self.boxes.append(element)
        if not self.hidden:
            self.articles += tag == "article"
            self.mains += tag == "main"
        self.open.append((tag, role, element))
        self.count[tag] += 1
        self.hidden += role == "hidden"
        self.hidden_blocks += role == "hidden" and tag in BLOCKS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.count[tag]:
            self._close(tag)

    def _close(self, tag: str | None) -> None:
        """Ends the innermost open element of that name, and those inside it; all elements where it is None."""
        if tag is None or tag in BLOCKS:
            self.flush()
        while self.open:
            name, role, element = self.open.pop()
            if name in BLOCKS and self.parts:
                self.flush()
            self.count[name] -= 1
            self.hidden -= role == "hidden"
            self.hidden_blocks -= role == "hidden" and name in BLOCKS
            if element is not None:
                element.lines = (element.lines[0], len(self.texts))
                element.articles = (element.articles[0], self.articles)
                element.mains = (element.mains[0], self.mains)
                element.closed = name == tag
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        # An inline element set aside (a script in a paragraph) ends no line.
        if self.hidden:
            self.dropped |= self.hidden_blocks > 0 and not data.isspace()
            return
        self.parts.append(data)
        if not self.count["a"]:
            self.plain_now += len("".join(data.split()))

    def kept(self) -> np.ndarray:
        """Whether each line is content: no element that is set aside is around it."""
        plain = np.array(self.plain, np.int64)
        over_lines, beside_lines, over_articles = _Cover(len(self.texts)), _Cover(len(self.texts)), _Cover(self.articles)

        def cover(element: _Element, by: int) -> None:
            over_lines.add(element.lines, by)
            over_articles.add(element.articles, by)
            if element.role == "beside":
                beside_lines.add(element.lines, by)

        def swallowed(element: _Element) -> bool:
            only = element.articles[1] > element.articles[0] and not (over_articles.depth() == 0).any()
            return only or 2 * plain[slice(*element.lines)].sum() > plain.sum()

        for element in self.weighed:
            cover(element, 1)
        for element in self.weighed:
            if element.role == "beside" and (element.mains[1] > element.mains[0] or (not element.closed and swallowed(element))):
                cover(element, -1)
        upto = np.concatenate([[0], np.cumsum(np.where(beside_lines.depth() == 0, plain, 0))])
        cores = [box for box in self.boxes if box.tag in ("article", "main")]
        rest, outside, apart = None, False, False
        for element in self.weighed:
            if element.role != "marked":
                continue
            if rest is None:
                rest = int(plain[over_lines.depth() == 0].sum())
                outside = bool((over_articles.depth() == 0).any())
                # An article of its own, with text, that no element set aside is around.
                free = np.concatenate([[0], np.cumsum(np.where(over_lines.depth() == 0, plain, 0))])
                apart = any(free[box.lines[1]] > free[box.lines[0]] for box in cores)
            mine = int(upto[element.lines[1]] - upto[element.lines[0]])
            most = 2 * mine > upto[-1] and mine >= 9 * rest
            has_article = element.articles[1] > element.articles[0]
            if element.mains[1] > element.mains[0] or (most and not apart) or (has_article and not outside and mine >= rest):
                cover(element, -1)
                rest = None
        return over_lines.depth() == 0


class _Cover:
    """How many ranges cover each of n places."""

    def __init__(self, n: int) -> None:
        self.change = np.zeros(n + 1, np.int64)

    def add(self, places: tuple[int, int], by: int) -> None:
        self.change[places[0]] += by
        self.change[places[1]] -= by

    def depth(self) -> np.ndarray:
        return np.cumsum(self.change)[:-1]


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing that weighs what there is at the ends."""
    radius = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    whole = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page._close(None)
    lines = np.flatnonzero(page.kept())
    if not len(lines):
        return ""
    sizes = np.array([len(page.texts[i]) for i in lines], np.float64)
    ratios = smoothed(sizes / np.maximum(1, np.array(page.n_tags)[lines]), sigma)
    core = np.zeros(len(page.texts), bool)
    core[lines] = ratios >= min(ratios.std(), ratios.max())
    weight = np.zeros(len(page.texts))
    weight[lines] = sizes
    upto = np.concatenate([[0.0], np.cumsum(np.where(core, weight, 0.0))])

    def held(box: _Element) -> float:
        return upto[box.lines[1]] - upto[box.lines[0]]

    def text_of(chosen) -> str:
        return "\n\n".join(page.texts[i] for i in chosen)

    whole = next((box for box in page.boxes if box.tag in ("article", "main") and 2 * held(box) > upto[-1]), None)
    if whole is not None:
        return text_of(lines[(whole.lines[0] <= lines) & (lines < whole.lines[1])])
    first, last, boxed = 0, len(page.texts), False
    for box in page.boxes:
        if 10 * held(box) >= 9 * upto[-1]:
            first, last = box.lines
            boxed = box.tag != "body"
    inside = lines[(first <= lines) & (lines < last)]
    start = 0 if boxed else np.flatnonzero(core[inside])[0]
    while start and page.heading[inside[start - 1]]:
        start -= 1
    return text_of(inside[start:])


def _extract(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with one more column, the page's main text."""
    return pages.withColumn(text_col, F.pandas_udf(_extract, "string")(F.col(html_col)))
