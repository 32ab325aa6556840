"""Main text of web pages: text-to-tag ratios of the lines that standard-library parser events give.

1. ``html.parser`` streams events. A line is the text of one block element, with the number of tags inside it, its characters
   within links, the section (article, main, section or division) that holds it, and the marks on its way up: elements whose
   role, class or id names a menu, a sidebar, a notice, comments, ...
2. A line's ratio is its characters outside links by its tags. The ratios are smoothed by a Gaussian over neighbouring lines, so
   that a short line between long ones counts with them. Marks and links are weights: a marked line weighs nothing and is
   passed over by the smoothing.
3. Lines at or above the standard deviation of the smoothed ratios are the content cluster.
4. The sections that hold a line of the content cluster, all of them, and what lies between two such sections beside each other are
   the content regions: their lines, short ones as well, are the text, but for lines that are links alone in a run of such lines,
   and headings before a line of it.
5. A mark counts only on what stands beside the article: one that holds the page's first heading or its main element, or,
   where no line would be left, most of the text, is a wrapper's and is passed over.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("caption tbody td tfoot th thead tr html head body title legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article main section div body".split())
#: Elements whose text is no part of an article.
DROPPED = frozenset("head title script style noscript template nav footer aside button select option textarea input label legend dialog menu iframe object svg math canvas audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of a class or id that mark what surrounds an article, alone or as the first or last part of a name.
MARKS = frozenset("ad ads adv advert advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side rail aside masthead topbar footer bottombar copyright comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login register search share sharing social related recommended recommendations trending pagination pager widget widgets toolbar skip".split())
#: Marks as a name of their own or with one of these before: an article's own header is part of it.
HEADERS, OF_SITE = "header", frozenset("site page top main global masthead".split())
COMMENTS = frozenset("comment comments respond reply replies disqus discussion".split())
#: The marks that count on an article element.
IN_ARTICLES = COMMENTS | frozenset("ad ads advert advertisement sponsored promo related".split())
#: First or last parts of a class that tell what state an element is in, or what it has, not what it is: ``has-sidebar``, ``comments-open``.
STATES = frozenset("has have is no not with without show hide open opened closed enabled disabled".split())
SIGMA, REACH = 1.0, 3
_NAME = re.compile(r"[^a-z0-9]+")


def _named_marks(token: str) -> frozenset[str]:
    """Marks that a class or id names: by its first or its last part, unless one of both is a state."""
    parts = [p for p in _NAME.split(token) if p]
    if not parts or len(parts) > 1 and not STATES.isdisjoint((parts[0], parts[-1])):
        return frozenset()
    found = MARKS.intersection((parts[0], parts[-1]))
    if parts[-1] == HEADERS and OF_SITE.issuperset(parts[:-1]):
        found |= {HEADERS}
    return found


class _Lines(HTMLParser):
    """Lines: text, tags, characters in links, section, the innermost mark (an index of ``marks``; -1: none), and whether it is a heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.open: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, -1)]  # tag, dropped, section, section is an article, mark
        self.count: Counter[str] = Counter()  # of open elements by tag
        self.marks: list[list] = []  # mark around it, whether it is of comments, whether it holds the heading or the main element
        self.text: list[str] = []
        self.parents = [0]  # of sections: the section around each
        self.tags = self.linked = 0
        self.heading = False

    def _end_line(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append((text, self.tags, min(self.linked, len(text)), self.open[-1][2], self.open[-1][4], self.open[-1][0] in HEADINGS))
            self.text = []
        self.tags = self.linked = 0

    def _pop_to(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.count.subtract(x[0] for x in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            if tag in ENDS_PARAGRAPH:
                self._pop_to("p", SECTIONS | {"ul", "ol", "table"})
            if tag == "li":
                self._pop_to(tag, SECTIONS | {"ul", "ol", "table"})
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        _, dropped, section, in_article, mark = self.open[-1]
        if not dropped:
            dropped, named = self._marked(tag, attrs, in_article)
            if named:
                self.marks.append([mark, not COMMENTS.isdisjoint(named), False])
                mark = len(self.marks) - 1
        if tag == "main" or tag == "h1" and not self.heading:
            self.heading |= tag == "h1" and not dropped
            around = mark
            while around >= 0 and not self.marks[around][1]:
                self.marks[around][2] = True
                around = self.marks[around][0]
        if tag in SECTIONS and not in_article:
            self.parents.append(section)
            section, in_article = len(self.parents) - 1, tag in ("article", "main")
        self.open.append((tag, dropped, section, in_article, mark))
        self.count[tag] += 1

    @staticmethod
    def _marked(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[bool, set[str]]:
        """Whether an element is dropped for what it is, and the marks of its names."""
        if tag in DROPPED or tag == "header" and not in_article:
            return True, set()
        named: set[str] = set()
        for k, v in attrs:
            value = (v or "").lower()
            if k in ("class", "id"):
                for token in value.split():
                    named |= _named_marks(token)
            elif k == "role" and value in DROPPED_ROLES:
                named.add(value)
            elif k == "hidden" or k == "aria-hidden" and value == "true" or k == "style" and "display:none" in value.replace(" ", ""):
                return True, set()
        if tag == "form":
            named.add(tag)
        elif tag == "article":
            named &= IN_ARTICLES
        return False, set() if tag in ("html", "body", "main") else named

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][1]:
            self.text.append(data)
            if self.count["a"] > 0:
                self.linked += len(data)


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    # Beyond the page's ends there are no lines; what lies within is weighted to one.
    return np.convolve(ratios, kernel)[REACH : REACH + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[REACH : REACH + len(ratios)]


def _beside(parser: _Lines) -> list[bool]:
    """Of each line, whether a mark that counts lies around it."""
    weight: list[int] = [0] * len(parser.marks)
    for text, _, linked, _, mark, _ in parser.lines:
        while mark >= 0:
            weight[mark] += len(text) - linked
            mark = parser.marks[mark][0]
    counts = [not wrapper for _, _, wrapper in parser.marks]

    def around(mark: int) -> bool:
        while mark >= 0:
            if counts[mark]:
                return True
            mark = parser.marks[mark][0]
        return False

    beside = [around(line[4]) for line in parser.lines]
    # Where all is marked, the mark around most of the text is a wrapper's; comments never are.
    while parser.lines and all(beside):
        wrappers = [m for m, (_, comments, _) in enumerate(parser.marks) if counts[m] and not comments]
        if not wrappers:
            break
        counts[max(wrappers, key=lambda m: (weight[m], -m))] = False
        beside = [around(line[4]) for line in parser.lines]
    return beside


def content_lines(parser: _Lines) -> np.ndarray:
    """Which lines are the main text."""
    beside = np.array(_beside(parser))
    own = [i for i in range(len(parser.lines)) if not beside[i]]
    chosen = np.zeros(len(parser.lines), bool)
    if not own:
        return chosen
    lines = [parser.lines[i] for i in own]
    ratios = np.array([(len(text) - linked) / max(1, tags) for text, tags, linked, *_ in lines])
    smooth = _smoothed(ratios)
    least = min(smooth.std(), smooth.max())
    content = smooth >= least
    sections = [line[3] for line in lines]
    # What is content by its neighbours alone and holds links is the menu or footer beside them.
    regions = {section for section, is_content, ratio, (_, _, linked, *_) in zip(sections, content, ratios, lines, strict=True) if is_content and (ratio >= least or not linked)}
    around, filled = parser.parents, np.zeros(len(lines), bool)
    for a, b in itertools.pairwise(np.flatnonzero([section in regions for section in sections]).tolist()):
        if sections[a] == sections[b] or around[sections[a]] == around[sections[b]] or sections[a] == around[sections[b]] or sections[b] == around[sections[a]]:
            filled[a : b + 1] = True
    # Lines that are links alone are menus where several follow each other and no line of the content cluster is among them.
    links = np.array([linked >= 0.9 * len(text) for text, _, linked, *_ in lines])
    run = links.copy()
    run[1:-1] = links[1:-1] & (links[:-2] | links[2:])
    run[:1], run[-1:] = links[:1] & links[1:2].any(), links[-1:] & links[-2:-1].any()
    chosen[own] = [(between or section in regions) and not menu for section, between, menu in zip(sections, filled, run, strict=True)]
    for before, after in reversed(list(itertools.pairwise(own))):
        if parser.lines[before][5] and chosen[after]:
            chosen[before] = True
    return chosen if chosen.any() or not regions else ~beside


def main_text(html: str) -> str:
    """The main text of one page; empty if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    if not parser.lines:
        return ""
    return " ".join(text for (text, *_), is_content in zip(parser.lines, content_lines(parser), strict=True) if is_content)


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without text outside menus, forms and the like: empty text. Null ids and urls stay null;
    repeated rows are extracted each; empty table: no rows; other columns are ignored, whatever their names. Very long and deeply
    nested pages are taken whole, in time that follows their length. Unclosed and stray tags are taken as a browser would: an end tag
    closes all within its element, a block ends an open paragraph.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInPandas(batches, "page_id bigint, url string, text string, n_chars bigint")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``."""
    return html_extract(table(spark, sf_dir, "pages"))
