"""Main text of web pages by text-to-tag ratios.

Parser events are folded, as they arrive, into lines (runs of text between block tags), each with its text length
outside links, its number of tags, and the container, list or table and article it stands in. Elements that hold
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments are left out beforehand,
by element and by class, id or role. The ratios of text outside links to tags are smoothed with a Gaussian and split by a
threshold into two clusters of lines:

* lists, tables and containers that hold no line above the threshold and are links by half or more are left out,
  wherever they stand;
* articles (outermost ``article`` or ``main``) compete with the containers outside of them by the text of their lines
  above the threshold. The best article is the main text, with the others that reach a fifth of it, unless a container
  outside has twice as much and ``SHORT`` characters at least; so teasers in articles do not replace a body. Of an article all other lines are taken;
* where no article is chosen, the containers outside that hold a line above the threshold are.

Edge cases: a null, empty or textless page gives an empty text, as does one of links alone without an article; unclosed and
crossed tags are closed by the next enclosing end tag; character references are decoded; text is never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td center".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
LISTS = frozenset("ul ol dl table".split())
#: Class and id words of what is left out: adverts, notices, menus, sidebars, headers, footers, forms, comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments commentlist disqus respond reply replies login search newsletter hidden".split()
)


def _left_out(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    given = dict(attrs)
    if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style") or "", re.I):
        return True
    if (given.get("role") or "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{given.get('class') or ''} {given.get('id') or ''}".lower().split():
        parts = re.split(r"[-_:]+|(?<=[a-z])(?=\d)", name)
        if MARKS.intersection(parts) and not {"has", "with", "no", "without"}.intersection(parts):
            return tag != "article" or bool({"comment", "comments", "ad", "ads", "advert", "sponsored", "related"}.intersection(parts))
    return False

#: Characters of prose below which nothing outside of an article replaces it.
SHORT = 200


class Line(NamedTuple):
    text: str
    links: int  # characters inside links
    tags: int
    container: int
    block: int  # the container, or the list or table in it
    article: int  # the outermost article, 0 outside of all


class Place(NamedTuple):
    tag: str = ""
    out: bool = False
    container: int = 0
    block: int = 0
    article: int = 0
    link: bool = False


class Lines(HTMLParser):
    """Folds events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Place()]
        self.held: list[str] = []
        #: Open elements by name: blocks, and inline elements since each open block.
        self.blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]
        self.links = self.tags = self.places = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            at = self.stack[-1]
            self.lines.append(Line(text, min(self.links, len(text)), self.tags, at.container, at.block, at.article))
            self.tags = 0
        self.links = 0
        self.held.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self.stack[-1]
        self.tags += not at.out
        if tag not in INLINE:
            self._end_line() if tag != "br" else self.held.append(" ")
        if tag in VOID:
            return
        if tag in CONTAINERS or tag in LISTS:
            self.places += 1
            at = at._replace(block=self.places, container=self.places if tag in CONTAINERS else at.container)
        if tag in ("article", "main") and not at.article:
            at = at._replace(article=self.places)
        self.stack.append(at._replace(tag=tag, out=at.out or _left_out(tag, attrs), link=at.link or tag == "a"))
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.blocks[tag] += 1
            self.inline.append(Counter())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.stack[-1].out
        if tag not in INLINE:
            self._end_line()
        if not (self.inline[-1] if tag in INLINE else self.blocks)[tag]:
            return  # nothing of that name is open; an inline end tag closes nothing outside its block
        if self.stack[-1].tag != tag and tag not in INLINE:
            self._end_line()
        while self._close_last() != tag:
            pass

    def _close_last(self) -> str:
        """Closes the last open element, so each element is closed once, whatever end tags follow."""
        tag = self.stack.pop().tag
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.blocks[tag] -= 1
            self.inline.pop()
        return tag

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].out:
            self.held.append(data)
            self.links += len(data.strip()) * self.stack[-1].link

    def close(self) -> None:
        super().close()
        self._end_line()


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones_like(ratios), kernel)[reach : reach + len(ratios)]


def chosen(lines: list[Line], sigma: float, share: float) -> list[bool]:
    """Which lines are main text."""
    plain = np.array([len(x.text) - x.links for x in lines])
    articles = np.array([x.article for x in lines])
    ratios = smooth(plain / np.maximum(1, [x.tags for x in lines]), sigma)
    top = ratios.max()
    prose = np.array([2 * x.links < len(x.text) for x in lines])
    hot = (ratios >= min(share * ratios.std(), top)) & prose if prose.any() else articles > 0
    with_hot = {b for x, h in zip(lines, hot, strict=True) if h for b in (x.block, x.container)}
    size, linked = Counter(), Counter()
    for x in lines:
        size[x.block] += len(x.text)
        linked[x.block] += x.links
    menu = {b for b in size if 2 * linked[b] >= size[b] and b not in with_hot} if prose.any() else set()
    inside, outside = Counter(dict.fromkeys(articles[articles > 0].tolist(), 0)), Counter()
    for x, h, n in zip(lines, hot, plain.tolist(), strict=True):
        if h:
            (inside if x.article else outside)[x.article or x.container] += n
    best = max(inside.values(), default=-1)
    rival = max(outside.values(), default=0)
    if best >= 0 and (2 * best >= rival or rival < SHORT):
        main = {a for a, n in inside.items() if 5 * n >= best}
        return [x.article in main and x.block not in menu for x in lines]
    return [not x.article and x.container in with_hot and x.block not in menu for x in lines]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    """The main text of one page. ``share``: of the standard deviation of the smoothed ratios, the content threshold."""
    if not isinstance(html, str) or not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return ""
    return " ".join(x.text for x, main in zip(parser.lines, chosen(parser.lines, sigma, share), strict=True) if main)


def extract_main_text(html: Column) -> Column:
    """The main text of each page of a column."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return extract(html)
