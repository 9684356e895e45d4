"""Main text of web pages from the events of the standard library's streaming HTML parser.

Parser events are folded into lines, one per block of text, each with its ratio of text to tags. The ratios are
smoothed along the page with a Gaussian; lines whose smoothed ratio is at least THRESHOLD standard deviations of all of
the page's (threshold clustering, as published with the text-to-tag ratio) are the seeds of content, and the containers
that hold seeds are the content regions. An article or main element is one region; its seeds count PRIOR times when the
regions of a page are weighed against each other, so cards that are articles do not outweigh a body in a div. What a
page marks as navigation, header, footer, sidebar, notice, advert, form, script, style or reader comment makes no lines
at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div html main section td".split())
UNREAD = frozenset("aside button canvas datalist embed footer form head iframe input menu meter nav noscript progress script select style svg template textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MARKED = frozenset(("article", "main"))
# a start tag of the first kind ends an open element of the second, up to an element of the third
CLOSED_BY = {
    "p": (frozenset("p".split()), frozenset("table td th button object body article section div main li".split())),
    "li": (frozenset("li".split()), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl".split())),
    "tr": (frozenset("tr td th".split()), frozenset("table".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset("option".split()), frozenset("select datalist".split())),
}
# Block elements that hold other blocks: only these are judged by their names.
NAMED = BLOCKS - HEADINGS - frozenset("address caption dt figcaption hr html body legend p pre summary".split())
# Words in class and id that mark what is not the article, unless a name of the article's own stands beside it; and
# unless a word of the third list stands beside it.
NEVER = frozenset("ad ads adv advert advertisement advertising adverts adslot sponsor sponsored comment comments commentlist disqus respond replies cookie cookies consent gdpr newsletter breadcrumb breadcrumbs paywall popup modal skiplink".split())
RARELY = frozenset("alert announcement banner bar bottombar byline copyright disclaimer foot footer header login masthead menu nav navbar navigation navi notice notices notification pager pagination promo promotion promoted recommended recommendations related search share sharing sidebar sidebars signup social subscribe tags teaser toolbar topbar widget widgets".split())
UNLESS = frozenset("article body content entry has main page post story text with without wrapper container layout no".split())
# A name that says a thing is absent, or its state, or (on blogs) the article's subject does not name the element.
ABSENT = frozenset("no not non has have with without category tag format".split())
STATES = frozenset("closed open disabled enabled hidden off on free".split())
# Names of these words alone are the article's own: as an id, or two and more of them together.
OWN = frozenset("article body content entry main page post story text".split())
# Whole class names that mark a paragraph or inline element as an advert.
ADVERTS = frozenset("ad ads advert advertisement advertising adverts adslot sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())

#: Standard deviation of the smoothing, in lines, and the seeds' threshold as a share of the ratios' deviation.
SIGMA, THRESHOLD = 1.0, 0.8
#: What a seed inside an article or main element counts against one outside; and the kinds of regions.
PRIOR = 2.0
PLAIN, MAIN, ARTICLE = 0, 1, 2

_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
_MARKED_SECTION = re.compile(r"<!\[[^>]*>?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _unread(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    if tag in UNREAD or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body") or not attrs:
        return False
    given = dict(attrs)
    if "hidden" in given or given.get("aria-hidden") == "true" or (given.get("role") or "").lower() in ROLES:
        return True
    if _HIDDEN.search(given.get("style") or ""):
        return True
    return tag != "main" and tag not in HEADINGS and _named_apart(tag, (given.get("class") or "").split(), (given.get("id") or "").split())


def _named_apart(tag: str, classes: list[str], ids: list[str]) -> bool:
    """Whether an element's names mark it as no part of the article."""
    if tag not in NAMED:
        return any(c.lower() in ADVERTS for c in classes)
    said: set[str] = set()
    for k, name in enumerate(classes + ids):
        words = [w.lower() for w in _SPLIT.split(name) if w]
        if not words or (len(words) > 1 and (words[0] in ABSENT or words[-1] in STATES)):
            continue
        if OWN.issuperset(words) and (len(words) > 1 or k >= len(classes)):
            return False
        said.update(words)
    return bool(said & NEVER) or (bool(said & RARELY) and not said & UNLESS)


class Lines(HTMLParser):
    """Folds parser events into lines: (text, tags, characters in links, region, its kind, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.open: list[tuple[str, bool]] = []  # element and whether it is unread
        self.unread = self.marked = self.links = 0
        self.containers, self.n_containers = [0], 0
        self.regions: list[tuple[int, int]] = []  # kind and container of the open article and main elements
        self.text, self.tags, self.link_chars = [], 0, 0
        self.heading = False
        self.in_header = 0  # headers inside articles: only their headings are read

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            # the outermost article, else main, is a region with all it holds
            kind, region = max(self.regions, key=lambda x: (x[0], -x[1]), default=(PLAIN, self.containers[-1]))
            self.lines.append((text, self.tags, self.link_chars, region, kind, self.heading))
            self.tags = 0
        self.text, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag in MARKED and self.unread and any(t in ("nav", "header") and u for t, u in self.open) and not _unread(tag, attrs, True):
            while self.open and self.unread:  # an unclosed menu ends where the article starts
                self._pop()
        if tag in CLOSED_BY:
            closed, until = CLOSED_BY[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in closed:
                    while len(self.open) > i:
                        self._pop()
                    break
                if self.open[i][0] in until:
                    break
        unread = _unread(tag, attrs, self.marked > 0)
        self.open.append((tag, unread))
        self.unread += unread
        self.marked += tag in MARKED
        self.links += tag == "a"
        self.in_header += tag == "header"
        if tag in CONTAINERS:
            self.n_containers += 1
            self.containers.append(self.n_containers)
        if tag in MARKED:
            self.regions.append((ARTICLE if tag == "article" else MAIN, self.n_containers))
        if tag in HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script"):
            self.handle_endtag(tag)

    def _pop(self) -> None:
        tag, unread = self.open.pop()
        if tag in BLOCKS:
            self.flush()
        self.unread -= unread
        self.marked -= tag in MARKED
        if tag in MARKED:
            self.regions.pop()
        self.links -= tag == "a"
        self.in_header -= tag == "header"
        if tag in CONTAINERS and len(self.containers) > 1:
            self.containers.pop()
        if tag in HEADINGS:
            self.heading = False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in CONTAINERS and tag not in BLOCKS:
                return  # an inline element's end does not close a container

    def handle_data(self, data: str) -> None:
        if self.unread or (self.in_header and not self.heading):
            return
        self.text.append(data)
        if self.links:
            self.link_chars += len(data)


def _smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(3 * sigma) or 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def content_lines(lines: list, sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[str]:
    """Texts of the lines in content regions."""
    if not lines:
        return []
    ratios = np.array([max(0, len(text) - links) / (tags + 1) for text, tags, links, *_ in lines])
    level = _smoothed(ratios, sigma)
    seeds = level >= threshold * level.std() if len(lines) > 1 else np.ones(1, bool)
    weights: dict[tuple[int, int], float] = {}  # of regions with seeds, by kind and region
    for i in np.flatnonzero(seeds).tolist():
        at = lines[i][4], lines[i][3]
        weights[at] = weights.get(at, 0.0) + level[i] * (PRIOR if at[0] else 1.0)
    top = max(weights, key=lambda at: (weights[at], at[0]))
    if top[0] == PLAIN:
        regions = {at for at in weights if at[0] == PLAIN}
    elif top[0] == MAIN:  # articles inside that are small beside it are cards
        regions = {at for at in weights if at[0] == MAIN or (at[0] == ARTICLE and PRIOR * weights[at] >= weights[top])}
    else:
        regions = {at for at in weights if at[0]}
    # a region is a container with all its lines: short lines between seeds are no gaps
    kept = [(x[4], x[3]) in regions for x in lines]
    for i in range(len(lines) - 2, -1, -1):  # a heading belongs to the region it stands before
        loose = lines[i][4] == MAIN or (lines[i][4] == PLAIN and top[0] == PLAIN)
        kept[i] = kept[i] or (loose and lines[i][5] and kept[i + 1])
    return [x[0] for x, keep in zip(lines, kept) if keep]


def main_text(html: str | None) -> str:
    """The page's article, one line per block; white space inside a block is one space."""
    if not html:
        return ""
    if "<![" in html:
        html = _MARKED_SECTION.sub("", html)
    parser = Lines()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.flush()
    return "\n".join(content_lines(parser.lines))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars), one row per row of pages, from the whole html.

    Null and empty pages, and pages without content, give an empty text. A page that is cut short gives what comes
    before the cut; a tag cut in two is no text. Pages are read whole; a very long one takes about ten times its size in
    a worker. An empty table gives no rows. Repeated rows give repeated results; other columns are not read.
    """
    kinds = [T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType)]
    kinds += [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, T.StructType(kinds))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
