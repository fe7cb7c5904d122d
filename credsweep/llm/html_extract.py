"""Main text of web pages by text-to-tag ratios.

A page streams through the standard library's parser and falls into lines, one
for each block.  Every line has a text-to-tag ratio: its characters over the tags
met with it.  The ratios along the page are smoothed by a Gaussian, and the lines
above a threshold (the standard deviation) cluster into content.  The clusters
say which element of the page is the article; all of its blocks are kept, short
ones too, but for the parts whose element or class names tell menus, notices,
adverts, forms or reader comments.  Class names and forms only vote: an element
that holds most of the clusters' text stays, unless the article is elsewhere, and
so does one with clustered text whose name may mean something else.  Short blocks
beside the article's element that no heading leads to go, whatever their names.
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

from credsweep.llm.common import read, small_batches

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup td th time tt u var wbr".split())
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside button select option textarea input "
    "iframe object embed svg canvas audio video menu dialog".split())
ARTICLE = frozenset(("article", "main"))
KEPT = frozenset(("html", "body", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class and id words of parts that aren't the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars aside "
    "widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments "
    "commentlist respond reply replies responses disqus cookie cookies consent gdpr notice notices alert warning newsletter subscribe "
    "subscription signup login popup modal overlay share sharing social related recommended recommendations toolbar "
    "pagination pager skip copyright disclaimer paywall form hidden".split())
#: Those of them that a name with other words besides, such as share-price, may have for another reason.
AMBIGUOUS = frozenset("share sharing social notice notices header alert warning related recommended respond reply replies response responses form menu banner "
                      "hidden skip subscription disclaimer copyright promo promotion toolbar overlay aside".split())
#: Words that say nothing about what a part holds.
STRUCTURE = frozenset(
    "box bar wrap wrapper container block list item items section area inner outer link links button buttons btn top bottom left right main "
    "content body row col column columns panel zone slot unit group holder page site global primary secondary post icon icons module".split())
#: Elements that hold blocks, and headings.
CONTAINERS = frozenset("div section td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A block beside the article that no heading leads to has at most so many lines.
BESIDE = 2
#: First words that turn such a name into a mere property of a wrapper.
PROPERTY = frozenset("has no with without is not".split())
#: What an opening tag closes if it is still open.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table thead tbody tfoot select".split())
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element's attributes keep it from being shown."""
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or
               name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I) for name, value in attrs)


def is_boilerplate(attrs: list[tuple[str, str | None]]) -> int:
    """Whether an element's attributes name a part outside the article: 2, or 1 if the name may mean something else."""
    found = 0
    for name, value in attrs:
        if name in ("class", "id"):
            for token in (value or "").split():
                words = SPLIT.split(CAMEL.sub("-", token).lower())
                if words[0] not in PROPERTY and not BOILERPLATE.isdisjoint(words):
                    listed = BOILERPLATE.intersection(words)
                    plain = all(w in listed or w in STRUCTURE or len(w) < 3 or w.isdigit() for w in words)
                    found = max(found, 2 if plain or not listed <= AMBIGUOUS else 1)
        elif name == "role" and (value or "").strip().lower() in ROLES:
            found = 2
    return found


class Lines(HTMLParser):
    """Parser events to lines; elements are numbered in page order, 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag = [0], ["html"]
        self.named = [0]  # by an element: how surely its class, id or role, or being a form, speaks against it
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, dropped
        self.count: Counter[str] = Counter()  # open elements by tag
        self.links = 0  # open <a>
        self.mute, self.muted = "", 0  # an open inline element that isn't shown, and how many of its name are open in it
        self.lines: list[tuple[str, int, bool, int, int]] = []  # text, element, dropped, tags, characters in links
        self._text: list[str] = []
        self._tags = self._linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            tag, element, dropped = self.open[-1]
            self.lines.append((text, element, dropped, self._tags, self._linked))
            self._tags = 0
        self._text.clear()
        self._linked = 0

    def _pop(self, at: int) -> None:
        self.end_line()
        self.count.subtract(name for name, _, _ in self.open[at:])
        del self.open[at:]
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if tag == "a":
            self.links += 1
        if tag in INLINE:  # its name doesn't count: it is part of a sentence
            if self.muted:
                self.muted += tag == self.mute
            elif attrs and tag != "a" and tag not in VOID and is_hidden(attrs):
                self.mute, self.muted = tag, 1
            if tag in ("br", "td", "th", "img"):
                self._text.append(" ")
            return
        if tag in VOID:
            if tag not in DROPPED:
                self.end_line()
            return
        self.end_line()
        self.muted = 0
        closes = IMPLIED.get(tag, ())
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name in closes or name == "p" and tag not in INLINE:
                self._pop(at)
                break
            if name in SCOPE or name not in closes and name != "p" and not closes:
                break
        self.parent.append(self.open[-1][1])
        self.tag.append(tag)
        self.named.append(2 if tag == "form" else 0 if tag in KEPT else is_boilerplate(attrs))
        dropped = self.open[-1][2] or tag in DROPPED or tag not in KEPT and is_hidden(attrs)
        if tag == "main":  # a wrapper's class doesn't hide the main part
            dropped = any(name in DROPPED for name, _, _ in self.open)
        self.open.append((tag, len(self.tag) - 1, dropped))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.count[tag] > 0:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] == tag:
                    self._pop(at)
                    return
        if self.muted and tag == self.mute:
            self.muted -= 1
        if tag in ("td", "th"):
            self._text.append(" ")
        elif tag not in INLINE:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        self._text.append(data)
        if self.links:
            self._linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The ratios under a Gaussian that reaches three deviations to either side."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _root(page: Lines, seeds: np.ndarray, kept: np.ndarray, length: np.ndarray) -> tuple[int, set[int]]:
    """The element that is the article, since it holds the clusters, and elements in it that are beside it."""
    n = len(page.tag)
    element = np.array([x[1] for x in page.lines])
    seed_mass = np.bincount(element, weights=length * seeds, minlength=n)
    mass = np.bincount(element, weights=length * kept, minlength=n)
    for e in range(n - 1, 0, -1):  # a child's number is above its parent's
        seed_mass[page.parent[e]] += seed_mass[e]
        mass[page.parent[e]] += mass[e]
    articles = [e for e in range(n) if page.tag[e] in ARTICLE and mass[e] > 0]
    if articles:
        best = max(articles, key=lambda e: (seed_mass[e], mass[e], -e))
        whole = seed_mass[[e for e in articles if page.parent[e] not in articles]].sum()
        while seed_mass[best] < 0.5 * whole and best:  # several articles make up the page
            best = page.parent[best]
        return best, set()
    best = 0
    for e in range(1, n):  # the deepest element with nearly all that the clusters hold
        if seed_mass[0] and seed_mass[e] >= 0.9 * seed_mass[0] and page.parent[e] == best:
            best = e
    # up again over headings and leads, but not over lists of links
    linked = np.bincount(element, weights=np.array([x[4] for x in page.lines]) * kept, minlength=n)
    for e in range(n - 1, 0, -1):
        linked[page.parent[e]] += linked[e]
    children: dict[int, list[int]] = {}
    for e in range(1, n):
        if mass[e]:
            children.setdefault(page.parent[e], []).append(e)
    rows = np.bincount(element, weights=kept, minlength=n)
    headed = np.array([tag in HEADINGS for tag in page.tag]) & (mass > 0)
    for e in range(n - 1, 0, -1):
        rows[page.parent[e]] += rows[e]
    headings = np.flatnonzero(headed)
    for e in range(n - 1, 0, -1):
        headed[page.parent[e]] |= headed[e]

    def beside(parent: int, core: int) -> set[int]:
        """Short blocks of ``parent`` without a heading of their own that stand before any heading or after ``core``."""
        first = headings[0] if len(headings) else core
        return {c for c in children.get(parent, ()) if c != core and page.tag[c] in CONTAINERS and rows[c] <= BESIDE and not headed[c] and (c > core or c < first)}

    core = max(children.get(best, [0]), key=lambda e: (seed_mass[e], -e))
    foreign = beside(best, core) if core and 2 * seed_mass[core] > seed_mass[best] and rows[core] > BESIDE else set()
    while best:
        up = page.parent[best]
        if (more := mass[up] - mass[best]) and linked[up] - linked[best] > 0.3 * more:
            break
        if rows[best] > BESIDE:
            foreign |= beside(up, best)
        best = up
    return best, foreign


def by_name(page: Lines, seeds: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each element, whether it goes because of a name that it or one around it has.

    An element whose name may mean something else counts as named if it has no
    clustered text or most of its text is links.  A
    named element stays if it holds more than half of the clusters' text, no
    <article> or <main> outside it has some, and what stays outside has less than
    a quarter of its text.  If only named elements hold text, all of them stay.
    """
    n = len(page.tag)
    element = np.array([x[1] for x in page.lines])
    own = np.bincount(element, weights=length * seeds, minlength=n)
    mass = own.copy()
    whole = np.bincount(element, weights=length, minlength=n)
    linked = np.bincount(element, weights=np.array([x[4] for x in page.lines], dtype=float), minlength=n)
    for e in range(n - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
        whole[page.parent[e]] += whole[e]
        linked[page.parent[e]] += linked[e]
    named = [v > 1 or v and (mass[e] == 0 or 2 * linked[e] > whole[e]) for e, v in enumerate(page.named)]
    # elements with most of the text lie in one another; depth counts those around an element, -1: another named one is
    chain: list[int] = []
    depth = [0] * n
    for e in range(1, n):
        up = depth[page.parent[e]]
        if page.tag[e] == "main":  # a wrapper's name doesn't hide the main part
            up = max(up, 0)
        if named[e] and up >= 0:
            if 2 * mass[e] > mass[0]:
                chain.append(e)
                up = len(chain)
            else:
                up = -1
        depth[e] = up
    outside = np.zeros(len(chain) + 1)  # clusters' text by depth
    for e in range(n):
        if depth[e] >= 0:
            outside[depth[e]] += own[e]
    around = set()
    e = chain[-1] if chain else 0
    while e:
        around.add(e)
        e = page.parent[e]
    articles = [depth[e] for e in range(n) if page.tag[e] in ARTICLE and depth[e] >= 0 and mass[e] > 0 and e not in around]
    stay = 0
    for k in range(len(chain)):
        if 4 * outside[:k + 1].sum() >= mass[chain[k]] or any(d <= k for d in articles):
            break
        stay = k + 1
    gone = np.array([not 0 <= d <= stay for d in depth])
    has_text = np.bincount(element[[not x[2] for x in page.lines]], minlength=n) > 0
    return gone if (has_text & ~gone).any() else np.zeros(n, dtype=bool)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's text, one line a block; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    kept = np.array([not x[2] for x in page.lines])
    if not kept.any():
        return ""
    length = np.array([len(x[0]) for x in page.lines], dtype=float)
    ratios = smoothed(length / np.maximum(1, [x[3] for x in page.lines]), sigma)
    kept &= ~by_name(page, kept & (ratios >= min(ratios.std(), ratios[kept].max())), length)[[x[1] for x in page.lines]]
    seeds = kept & (ratios >= min(ratios.std(), ratios[kept].max()))
    root, foreign = _root(page, seeds, kept, length)
    inside = np.zeros(len(page.tag), dtype=bool)
    inside[root] = True
    for e in range(root + 1, len(page.tag)):
        inside[e] = inside[page.parent[e]] and e not in foreign
    return "\n".join(x[0] for x, k in zip(page.lines, kept, strict=True) if k and inside[x[1]])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.0) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page.

    Null and empty pages give an empty text; every row gives one row, repeated
    ones too.  No shuffle: a page is parsed where it is read, a batch at a time.
    """
    rows = small_batches(pages.select(*keep, pages[html_col].alias("html__")))
    schema = rows.drop("html__").schema.add("text", "string").add("n_chars", "long")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(x.as_py(), sigma) for x in batch.column("html__")]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(batches, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
