"""Main text of web pages by tag-path ratios.

Every block of text has a path of block-level tags from the root. Text length
and punctuation are summed per path and divided by the number of its blocks,
so that a short paragraph scores like its siblings. The two series along the
page are smoothed, fused (geometric mean) and thresholded at a share of their
standard deviation. The element that holds all of the selected text, or the
article it lies in, then also gives its headings, short blocks and lists of
links; no selected block is left out. Blocks in menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles take no part.
Names that article parts share with page parts (header, meta, search, byline)
tell only outside the article: in it, and beside selected text, they stay.
An element around the article isn't dropped for its name.

Paths are numbers with a parent, bans are handed down from parent to child,
and tags close what a count says is open, so the time is linear in the page.

Defined results: null or empty html gives an empty text; unclosed and
misnested tags are closed by their ancestors or by the next block; text
without any tag is one block; nothing is capped, whatever its length.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A path is content from this share of the standard deviation of the fused ratios.
THRESHOLD = 0.6
#: Weights of a block's neighbours at distances 0, 1, 2.
KERNEL = (1.0, 0.6, 0.15)
#: Blocks without a class that go on with the text where no element holds it alone.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())

# Fixed values of the HTML standard: elements that don't break a block, that have no end tag, whose content isn't markup.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
#: An opening tag of the key closes an open one of the values, unless a listed scope lies between.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table article section div main aside nav body".split())

BANNED_TAGS = frozenset("head nav footer aside form button select option datalist fieldset dialog menu object audio video canvas input".split()) | RAW
BANNED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note status".split())
_NAMES = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
COMMENT_NAMES = re.compile(_NAMES % "comments?|commentlist|disqus|respond|replies|reply", re.I)
BANNED_NAMES = re.compile(
    _NAMES % "ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion|s)?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|"
    "sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|related|recommended|share|sharing|social|widgets?|pagination|pager|toolbar",
    re.I,
)
#: Names of page parts that parts of an article have too.
SHARED_NAMES = re.compile(_NAMES % "side|topbar|masthead|header|footer|foot|copyright|search|skip|disclaimer|tags|meta|byline", re.I)
#: Levels of a ban: by a shared name, by a name or role, by the tag.
SHARED, NAMED, TAGGED = 1, 2, 3
#: These aren't dropped for their class: it often tells of their children.
ROOTS = frozenset("html body main article".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟،»«“”]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _banned(tag: str, attributes: str, in_content: bool) -> tuple[int, bool]:
    """(level of the ban, or 0; whether it is for comments)"""
    if tag in BANNED_TAGS:
        return TAGGED, False
    level = SHARED if tag == "header" and not in_content else 0
    if not attributes or tag in ROOTS:
        return level, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            if COMMENT_NAMES.search(value):
                return NAMED, True
            if BANNED_NAMES.search(value):
                level = NAMED
            elif not in_content and SHARED_NAMES.search(value):
                level = max(level, SHARED)
        elif name == "role" and value.strip().lower() in BANNED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return NAMED, True
    return level, False


class _Open(NamedTuple):
    """An open element: its name, path, number, and whether it lies in an article."""

    name: str
    path: int
    number: int
    in_content: bool


class Page:
    """Blocks (path, text, share of its text in links, level of its ban) in page order; paths as (parent, label), 0 being the root."""

    def __init__(self, page: str):
        self.paths: list[tuple[int, str]] = [(0, "")]
        self._known: dict[tuple[int, str], int] = {}
        # of elements: parent, own ban, whether it can be lifted, whether an article lies in it
        self._parent, self._own, self._fixed, self._core = [0], [0], [True], [True]
        self._stack = [_Open("", 0, 0, False)]
        # open elements by name: all, those since the last scope, inline ones since the last block
        self._open: dict[str, int] = defaultdict(int)
        self._scopes: list[dict[str, int]] = [defaultdict(int)]
        self._inline: list[dict[str, int]] = [defaultdict(int)]
        self._parts: list[str] = []
        self._linked = 0
        self._found: list[tuple[int, str, float, int]] = []
        self._read(page)
        ban = [0] * len(self._own)
        for e in range(1, len(ban)):
            lifted = self._core[e] and not self._fixed[e]
            ban[e] = max(ban[self._parent[e]], 0 if lifted else self._own[e])
        self.blocks = [(path, text, linked, ban[e]) for path, text, linked, e in self._found]

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(htmllib.unescape("".join(self._parts)).split())
            self._parts.clear()
            if text:
                top = self._stack[-1]
                self._found.append((top.path, text, min(1.0, self._linked / len(text)), top.number))
        self._linked = 0

    def _close(self, upto: int) -> None:
        while len(self._stack) > upto:
            x = self._stack.pop()
            self._open[x.name] -= 1
            if x.name in INLINE:
                self._inline[-1][x.name] -= 1
                continue
            self._inline.pop()
            if x.name in SCOPE:
                self._scopes.pop()
            else:
                self._scopes[-1][x.name] -= 1

    def _last(self, names: tuple[str, ...], number: int) -> int:
        """Place in the stack of the ``number``-th open element of these names from the top."""
        i = len(self._stack)
        while number:
            i -= 1
            number -= self._stack[i].name in names
        return i

    def _push(self, tag: str, attributes: str) -> None:
        top = self._stack[-1]
        level, fixed = _banned(tag, attributes, top.in_content)
        number = len(self._own)
        self._parent.append(top.number)
        self._own.append(level)
        self._fixed.append(fixed or level == TAGGED)
        self._core.append(False)
        path, content = top.path, top.in_content
        self._open[tag] += 1
        if tag in INLINE:
            self._inline[-1][tag] += 1
        else:
            name = next((v[1] or v[2] or v[3] for v in _ATTRIBUTE.findall(attributes) if v[0].lower() == "class"), "") if attributes else ""
            label = f"{tag}.{name}" if name else tag
            path = self._known.get((top.path, label), 0)
            if not path:
                path = self._known[top.path, label] = len(self.paths)
                self.paths.append((top.path, label))
            self._inline.append(defaultdict(int))
            if tag in SCOPE:
                self._scopes.append(defaultdict(int))
            else:
                self._scopes[-1][tag] += 1
            if tag in ("article", "main"):
                content, e = True, top.number
                while not self._core[e]:
                    self._core[e] = True
                    e = self._parent[e]
        self._stack.append(_Open(tag, path, number, content))

    def _read(self, page: str) -> None:
        at, end, last = 0, len(page), page.rfind(">")
        while at < end:
            m = _TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 or page.find("<?", at) >= 0 else None
            text = page[at : m.start() if m else end]
            if text:
                self._parts.append(text)
                if self._open["a"]:
                    self._linked += len(text)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag == "br":
                self._parts.append(" ")
                continue
            if tag in RAW:
                # its content is no text, and it breaks no block
                if not m[1] and not m[3].endswith("/"):
                    ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at, last + 1)
                    at = ends.end() if ends else end
                continue
            inline = tag in INLINE
            if not inline:
                self._flush()
            if m[1]:
                if (self._inline[-1] if inline else self._open)[tag]:
                    self._close(self._last((tag,), 1))
                continue
            if not inline:
                # a block ends an open paragraph, and some end their open siblings
                closes = ("p", *IMPLIED.get(tag, ()))
                if number := sum(self._scopes[-1][c] for c in closes):
                    self._close(self._last(closes, number))
            if tag not in VOID:
                self._push(tag, m[3])
        self._flush()


def _smooth(x: np.ndarray) -> np.ndarray:
    k = np.array([*KERNEL[:0:-1], *KERNEL])
    return np.convolve(x, k)[len(KERNEL) - 1 : len(KERNEL) - 1 + len(x)] / np.convolve(np.ones(len(x)), k)[len(KERNEL) - 1 : len(KERNEL) - 1 + len(x)]


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by one space."""
    if not page:
        return ""
    read = Page(page)
    every, paths = read.blocks, read.paths
    found = [b for b in every if not b[3]] or [b for b in every if b[3] < TAGGED]
    if not found:
        return ""
    length, punctuation, number = defaultdict(float), defaultdict(float), defaultdict(int)
    for path, text, linked, _ in found:
        length[path] += len(text) * (1 - linked)
        punctuation[path] += len(_PUNCTUATION.findall(text)) * (1 - linked)
        number[path] += 1
    text_ratio = _smooth(np.array([length[b[0]] / number[b[0]] for b in found]))
    punctuation_ratio = _smooth(np.array([punctuation[b[0]] / number[b[0]] for b in found]))
    fused = np.sqrt(text_ratio * (punctuation_ratio + 0.1))
    threshold = max(THRESHOLD * float(fused.std()), 0.05 * float(fused.max()))
    selected = {id(b) for b, f in zip(found, fused) if f >= threshold and b[2] < 0.5}
    if not selected:
        return " ".join(b[1] for b in found if b[2] < 0.5)
    # the lowest element that holds all selected text, or the article it lies in; parents have smaller numbers
    parents = {paths[b[0]][0] for b in found if id(b) in selected}
    held = [0] * len(paths)
    for x in parents:
        held[x] = 1
    for x in range(len(paths) - 1, 0, -1):
        held[paths[x][0]] += held[x]
    container = max(x for x in range(len(paths)) if held[x] == len(parents))
    kind = lambda x: paths[x][1].split(".")[0]
    article = container
    while article and kind(article) not in ("article", "main"):
        article = paths[article][0]
    container = article or container
    # the elements of which selected blocks are children are the article's own, their menus of links too
    own = {x for x in parents if x and kind(x) not in ("html", "body")} | ({container} if article else set())
    under, within = [False] * len(paths), [False] * len(paths)
    for x in range(len(paths)):
        up = paths[x][0]
        under[x] = x == container or x > 0 and under[up]
        within[x] = x in own or x > 0 and within[up]
    # besides those without a ban, what a shared name marks beside selected text
    found = [b for b in every if not b[3] or b[3] == SHARED and within[paths[b[0]][0]] or id(b) in selected]
    inside = {i for i, b in enumerate(found) if under[b[0]] and b[2] < 0.5 and not b[3]}
    chosen = [i for i, b in enumerate(found) if id(b) in selected]
    first, last = chosen[0], chosen[-1]
    if not container or kind(container) in ("html", "body"):
        # no container of its own: up to the last block of running text beside the selected ones
        while last + 1 < len(found) and paths[found[last + 1][0]][0] in parents and found[last + 1][2] < 0.5 and paths[found[last + 1][0]][1] in PROSE:
            last += 1
        inside = {i for i in inside if first <= i <= last}
    inside |= {i for i, b in enumerate(found) if within[b[0]]} | set(chosen)
    # the headings right before
    first = min(inside)
    while first and kind(found[first - 1][0]) in ("h1", "h2"):
        first -= 1
        inside.add(first)
    return " ".join(found[i][1] for i in sorted(inside))


@F.pandas_udf(T.StringType())
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(p) for p in batch], dtype=object)


def extract(html: Column) -> Column:
    """Main text of each page; never null."""
    return _extract(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row; one pass, no shuffle."""
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
