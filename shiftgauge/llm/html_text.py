"""Main text of web pages by text-to-tag ratios.

The events of the standard library's parser stream a page into lines, one for each block, under a tree of
the elements that hold them. A line's ratio is its text outside links by its tags; ratios are smoothed by a Gaussian over
neighbouring lines and split into two clusters, whose border marks lines of content. The element that most
content lines lie in is the article; of it everything is kept but what its markup names as something else.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the Gaussian, in lines, and how far it reaches.
SIGMA, REACH = 1.0, 3
#: An element with this share of its parent's content stands for all of it.
MOST_CONTENT = 0.6
#: An article is taken at once from this share of all content on.
ARTICLE_CONTENT = 0.2
#: Parts of an article with a larger share of link text and no line of content are menus.
MOST_LINKS = 0.5
ROUNDS = 30

# Elements by their part in a page, and words of class, id and role that name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
SILENT = frozenset(
    "audio button canvas iframe noscript object script select style svg template textarea title video".split()
)
PARAGRAPHS = frozenset("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("aside dialog footer form head menu nav".split())
WHOLE = frozenset("article body html main".split())
NAMES = frozenset(
    "ad ads adsense adv advert advertisement advertising advertisements adverts sponsor sponsored sponsors promo promoted promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar masthead topbar skip "
    "footer colophon copyright sidebar aside complementary contentinfo rail widget widgets related recommended recommendations trending "
    "share sharing social cookie cookies consent gdpr notice notices notification alert alertdialog banner popup modal dialog overlay "
    "newsletter subscribe subscription signup login search form "
    "comment comments commentlist discussion disqus respond reply replies".split()
)
_ARTICLE_NAMES = frozenset("article content entry post story".split())
_WITHOUT = frozenset("has no not with without".split())
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile("<[A-Za-z/!?]")


class PageLines(HTMLParser):
    """Lines and elements of a page; element 0 is the page itself, and parents come before their children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.named, self.closed = [-1], ["html"], [False], [True]
        self.texts: list[str] = []
        self.links: list[int] = []
        self.tags: list[int] = []
        self.at: list[int] = []
        self.headings: list[str] = []
        self._open: list[tuple[str, int]] = [("", 0)]  # tag and element
        self._count: Counter[str] = Counter()
        self._silent = 0
        self._block = ""
        self._parts: list[str] = []
        self._linked, self._in_link, self._seen = 0, False, 0

    def read(self, html: str) -> PageLines:
        # A comment or tag without end hides the rest; other declarations end at the next bracket.
        html = html.replace("<![", "<!x[")
        ends = html.rfind("-->") + 1
        hidden = html.find("<!--", ends)
        html = html[:hidden] if hidden >= 0 else html
        unclosed = _TAG.search(html, html.rfind(">") + 1)
        self.feed(html[: unclosed.start()] if unclosed else html)
        self.close()
        self._line()
        return self

    def _line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.texts.append(text)
            self.links.append(self._linked)
            self.tags.append(self._seen)
            self.at.append(self._open[-1][1])
            self.headings.append(self._block if self._block in HEADINGS else "")
        self._parts, self._linked, self._seen = [], 0, 0

    def _pop(self) -> tuple[str, int]:
        tag, element = self._open.pop()
        self._count[tag] -= 1
        self._silent -= tag in SILENT
        return tag, element

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._seen += 1
        if tag == "br":
            self._parts.append("\n")
        if tag == "a":
            self._in_link = True
        if tag in VOID and tag != "hr" or tag in INLINE:
            return
        if tag in SILENT:
            self._open.append((tag, self._open[-1][1]))
            self._count[tag] += 1
            self._silent += 1
            return
        self._line()
        self._block = tag
        if tag == "hr":
            return
        while self._open[-1][0] in PARAGRAPHS and not (tag in PARAGRAPHS and self._nests(self._open[-1][0], tag)):
            if tag not in PARAGRAPHS and self._open[-1][0] not in HEADINGS and self._open[-1][0] != "p":
                break
            self._pop()
        element = self._open[-1][1]
        named = bool(attrs) and tag not in WHOLE and _named(attrs)
        if named or tag not in PARAGRAPHS:
            element = len(self.parent)
            self.parent.append(self._open[-1][1])
            self.tag.append("header" if named == "header" else tag)
            self.named.append(named is True or tag in WHOLE and bool(attrs) and _named(attrs) is True)
            self.closed.append(False)
        self._open.append((tag, element))
        self._count[tag] += 1

    @staticmethod
    def _nests(outer: str, inner: str) -> bool:
        return outer != inner and (outer in ("tr", "td", "th", "li", "dd") and inner not in ("tr", "li", "dt", "dd") or outer == "tr")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self._seen += 1
        if tag == "a":
            self._in_link = False
        if not self._count[tag]:
            return
        if tag not in SILENT:
            self._line()
            self._block = ""
        while True:
            popped, element = self._pop()
            if popped == tag:
                self.closed[element] |= element != self._open[-1][1]
                break
        if tag not in PARAGRAPHS:
            self._in_link = False

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._parts.append(data)
            if self._in_link:
                self._linked += len("".join(data.split()))


def _named(attrs: list[tuple[str, str | None]]) -> bool | str:
    """Whether class, id or role name what is no article; "header" for a heading part."""
    found: list[str] = []
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            words = [w.lower() for w in _NAME.findall(value)]
            found += [w for before, w in zip(["", *words], words, strict=False) if before not in _WITHOUT]
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and value and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return True
    if not NAMES.isdisjoint(found):
        return True
    return "header" if "header" in found else False


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios averaged over neighbours with Gaussian weights; the page's ends have fewer neighbours."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    total = np.convolve(ratios, kernel)[REACH : REACH + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[REACH : REACH + len(ratios)]


def border(values: np.ndarray) -> float:
    """Border between a low and a high cluster, midway between their means, on a scale of logarithms; equal values are all high."""
    scaled = np.log1p(values)
    cut = (scaled.min() + scaled.max()) / 2
    for _ in range(ROUNDS):
        high = scaled >= cut
        if high.all():
            break
        moved = (scaled[high].mean() + scaled[~high].mean()) / 2
        if moved == cut:
            break
        cut = moved
    return float(np.expm1(cut))


def _sums(parent: list[int], at: np.ndarray, values: np.ndarray) -> list[int]:
    """Sum over the lines of each element and all below it."""
    sums = np.bincount(at, values, len(parent)).astype(np.int64).tolist()
    for i in range(len(parent) - 1, 0, -1):
        sums[parent[i]] += sums[i]
    return sums


def main_text(html: str | None) -> str:
    """Text of the article of a page; empty for null and empty pages and those without any."""
    page = PageLines().read(html or "")
    if not page.texts:
        return ""
    parent, tag, at = page.parent, page.tag, np.array(page.at)
    chars = np.array([len(t.replace(" ", "")) for t in page.texts])
    plain = np.maximum(chars - np.array(page.links), 0)
    all_chars = _sums(parent, at, plain)

    # Elements around the longest article, or around the main element, are not excluded by their names.
    articles = [i for i, t in enumerate(tag) if t in ("article", "main") and not page.named[i]]
    wraps = [False] * len(parent)
    longest = max(articles, key=lambda i: (tag[i] == "article", all_chars[i]), default=0)
    above = longest
    while above > 0:
        wraps[above] = True
        above = parent[above]

    inside, out, heads = [False] * len(parent), [False] * len(parent), [False] * len(parent)
    direct = [False] * len(parent)  # excluded elements without an end hold their own lines only
    for i in range(1, len(parent)):
        up = parent[i]
        inside[i] = inside[up] or tag[i] in ("article", "main")
        heads[i] = heads[up] or tag[i] == "header" and inside[i]
        other = page.named[i] and not wraps[i] or tag[i] in ASIDE and not (wraps[i] and tag[i] == "form")
        other |= tag[i] == "header" and not inside[i] and not wraps[i]
        out[i] = out[up] or other and page.closed[i]
        direct[i] = other and not page.closed[i]
    kept = np.array([not (out[i] or direct[i] or heads[i] and not h) for i, h in zip(page.at, page.headings, strict=True)])
    if not kept.any():
        return ""

    ratios = np.where(kept, plain / np.maximum(np.array(page.tags), 1), 0)
    smooth = smoothed(ratios)
    content = kept & (smooth >= border(smooth)) & (plain > 0)
    weights = _sums(parent, at, np.where(content, plain, 0))
    if not weights[0]:
        return ""
    best = [-1] * len(parent)
    for i in range(1, len(parent)):
        if best[parent[i]] < 0 or weights[i] > weights[best[parent[i]]]:
            best[parent[i]] = i
    chosen = 0
    if longest and tag[longest] == "article" and weights[longest] >= ARTICLE_CONTENT * weights[0]:
        chosen = longest
    while tag[chosen] not in ("article", "main") and best[chosen] >= 0 and weights[best[chosen]] >= MOST_CONTENT * weights[chosen]:
        chosen = best[chosen]
    titled = {i for i, h, k in zip(page.at, page.headings, kept.tolist(), strict=True) if k and h in ("h1", "h2")}
    while tag[chosen] not in WHOLE and chosen not in titled and parent[chosen] in titled and tag[parent[chosen]] not in ("body", "html"):
        chosen = parent[chosen]

    held, linked = _sums(parent, at, np.where(kept, chars, 0)), _sums(parent, at, np.where(kept, page.links, 0))
    within, menu = [False] * len(parent), [False] * len(parent)
    for i in range(len(parent)):
        up = parent[i]
        within[i] = i == chosen or up >= 0 and within[up]
        own = i != chosen and not weights[i] and linked[i] > MOST_LINKS * held[i]
        menu[i] = within[i] and (own or up >= 0 and menu[up])
    return " ".join(t for t, i, k in zip(page.texts, page.at, kept.tolist(), strict=True) if k and within[i] and not menu[i])


def main_texts(html: str | Column) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in pages], pa.string())

    return extract(html)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null and empty html give an empty text; null ids and urls stay; repeated rows are answered each; pages of any
    length are read whole; extra columns are left out; an empty table gives no rows.
    """
    texts = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        main_texts(pages["html"].cast("string")).alias("text"),
    )
    return texts.withColumn("n_chars", F.length("text").cast("long"))
