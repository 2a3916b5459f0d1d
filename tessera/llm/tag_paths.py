"""Main text of web pages by tag-path ratios (operator 2).

A page is read as a tree of block elements (inline markup is transparent). Every text block
has the tag path from the root to its element. Text length and punctuation are summed per
path and divided by its number of blocks; both ratios are smoothed over neighbouring blocks
in page order with a Gaussian window and multiplied, and by a factor for marks. A path is
content if the mean over its blocks reaches the threshold: a share of the spread of the ratios, and a share of their mean weighted by text.

Marks are the words of class and id that name adverts, comments, menus and the like. They
only lower a ratio: for adverts, comments and, outside ``article`` and ``main``, all marks so
far that a marked path passes just beside next to nothing else; inside, names made of such
words alone halve it and others count nothing. A mark on an element that wraps parts of a page counts
nothing, but for adverts and comments. Navigation, headers and footers of the page, asides,
forms, scripts and hidden elements are left out by element, role and attribute.

What is written are the blocks of content paths and, of the other unmarked blocks, those that
belong to them: blocks in an ``article`` or ``main`` or in the same container as content
(between content if that is the whole page), and headings right before content; but no
lists of links. If that gives nothing, forms are read, too, as when one spans the page.

Character references are decoded, white space in a block becomes one space, blocks are
joined by a line feed in page order. ``br`` is white space.

Cases: null, empty and text-free pages give ''; text without any markup is one block;
unclosed and crossing tags are closed as their parent or a sibling demands; a comment,
script or tag that never ends reaches to the end of the page. Work is per row and
linear in the page, whatever its depth.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_columns

SMOOTHING = (0.1, 0.8, 0.1)         # Gaussian window over neighbouring blocks
SPREAD = 0.8                        # a content path's score is at least so much of the spread of the ratios,
SHARE = 0.2                         # and of their mean weighted by text
MARKED, HALF = 0.02, 0.5            # factors for marks outside and inside articles
ADVERT = 0.01                       # for adverts and comments

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset(
    "html body main article section aside header footer nav div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu pre "
    "blockquote address figure figcaption table caption thead tbody tfoot tr td th form fieldset legend details "
    "summary dialog center hgroup search select optgroup option button label object video audio canvas head".split())
NEVER = frozenset("nav footer aside form fieldset select button dialog menu object video audio canvas head search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("body html #root".split())
PLACES = WHOLE | frozenset("div section article main td th center blockquote dialog".split())    # that hold blocks
CLOSES_P = BLOCKS - frozenset("select optgroup option button label object video audio canvas".split())
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
            "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
            "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"),
            "tfoot": ("thead tbody tfoot tr td th", "table"), "optgroup": ("option optgroup", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
# Words of class, id and role that mark what is no part of an article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead topbar "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations toolbar pagination pager skip".split())
UNMARKED = frozenset("has with without no".split())       # 'has-sidebar' says something about a page's layout
# Marks that may also name the subject or a part of an article.
TOPICAL = frozenset("header banner menu menus navigation notice notices notification alert related recommended recommendations "
                    "social share sharing subscription promotion reply replies respond consent cookie cookies".split())
PARTS = frozenset("entry post article story section content".split())     # 'entry-header' is a header of an article
WRAPS = frozenset("article main section header footer nav aside h1 form".split())     # stand in wrappers, not in adverts
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
# Words that say nothing about what a box holds.
BOXES = frozenset("list lists area areas section thread box wrapper container form block slot bar".split())
PUNCTUATION = re.compile(r"[.,;:!?¿¡…·'\"«»()、。，；：！？؟،।-]")

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Page:
    """The block elements and text blocks of a page, in page order."""

    def __init__(self, html: str, forms: bool = False):
        self.forms = forms                   # read forms, too
        # elements: parent, tag, tag path, left out, in an article or main, own mark
        self.parent, self.tag, self.path, self.out = [0], ["#root"], [0], [False]
        self.within, self.mark = [False], [1.0]
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[str] = []
        self.owner: list[int] = []           # element of each block
        self.linked: list[bool] = []         # whether all of its text is in links
        self._block = -1                     # number of the last one
        self._read(html)
        self._settle_marks()

    def _read(self, html: str) -> None:
        stack, count = [0], {}
        block = links = at = 0
        while True:
            m = _token.search(html, at)
            end = m.start() if m else len(html)
            if end > at and not self.out[stack[-1]]:
                self._add(html[at:end], stack[-1], block, links > 0)
            if not m:
                return
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if m.group(1):                                        # an end tag
                if name == "a":
                    links = 0
                elif name in BLOCKS:
                    if count.get(name):
                        while True:
                            done = self.tag[stack.pop()]
                            count[done] -= 1
                            if done == name:
                                break
                    block += 1
                continue
            attributes = m.group(3)
            if name in RAW and not attributes.endswith("/"):      # all up to its end tag is its own
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*>|</{name}\\Z", re.I).search(html, at)
                at = close.end() if close else len(html)
                continue
            if name in VOID or name not in BLOCKS:
                if name == "hr":
                    block += 1
                elif name == "br":
                    self._add(" ", stack[-1], block, links > 0)
                elif name == "a":
                    links = 1
                continue
            block += 1
            if name in CLOSES_P and count.get("p"):
                self._close(stack, count, frozenset(["p"]), frozenset("td th li div article section main button".split()))
            if name in SIBLINGS:
                self._close(stack, count, *SIBLINGS[name])
            up = stack[-1]
            self.parent.append(up)
            self.tag.append(name)
            self.path.append(self.paths.setdefault((self.path[up], name), len(self.paths) + 1))
            self.within.append(self.within[up] or name in ("article", "main"))
            self.out.append(self.out[up] or self._left_out(name, attributes, self.within[up]))
            self.mark.append(self._marked(name, attributes, self.within[up]))
            stack.append(len(self.tag) - 1)
            count[name] = count.get(name, 0) + 1

    def _close(self, stack, count, names, until) -> None:
        """Close the nearest of ``names`` and what is open in it, unless one of ``until`` comes first."""
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                for e in stack[i:]:
                    count[self.tag[e]] -= 1
                del stack[i:]
                if names == SIBLINGS["li"][0] or "p" in names:
                    return
                return self._close(stack, count, names, until)
            if tag in until:
                return

    def _left_out(self, name: str, attributes: str, within: bool) -> bool:
        if name in NEVER and not (self.forms and name in ("form", "fieldset")) or name == "header" and not within:
            return True
        if not attributes or name in ("html", "body"):
            return False
        if "hidden" in attributes.lower().split():
            return True
        for key, *values in _attribute.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "style" and _hidden.search(value) or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "role" and value.lower() in ROLES and not (self.forms and value.lower() == "form"):
                return True
        return False

    def _marked(self, name: str, attributes: str, within: bool) -> float:
        """The factor of the words of class and id."""
        if not attributes or name in ("html", "body"):
            return 1.0
        least = 1.0
        for key, *values in _attribute.findall(attributes):
            if key.lower() in ("class", "id"):
                named = [frozenset(w.lower() for w in _word.findall(n)) for n in "".join(values).split()]
                words = frozenset().union(*named)
                if words & UNMARKED:
                    continue
                only = lambda kinds: any(n & kinds and n <= kinds | BOXES for n in named)  # noqa: B023,E731
                if name in ("article", "main", "header") or within:
                    least = min(least, ADVERT if only(ADVERTS) or only(COMMENTS) else
                                HALF if within and only(MARKS - TOPICAL) else 1.0)
                elif words & (ADVERTS | COMMENTS):
                    least = min(least, ADVERT)
                elif words & (MARKS - {"header"} if words & PARTS else MARKS):
                    least = min(least, MARKED)
        return least

    def _settle_marks(self) -> None:
        """Every element's factor: the least of its own and those around it, but for elements that wrap parts of a page."""
        wraps = [False] * len(self.tag)
        for e in range(len(wraps) - 1, 0, -1):                    # parents come before children
            wraps[self.parent[e]] |= wraps[e] or self.tag[e] in WRAPS
        for e in range(1, len(wraps)):
            if wraps[e] and self.mark[e] in (MARKED, HALF):
                self.mark[e] = 1.0
            self.mark[e] = min(self.mark[e], self.mark[self.parent[e]])

    def _add(self, text: str, owner: int, block: int, linked: bool) -> None:
        blank = text.isspace()
        if block == self._block:
            self.texts[-1] += text
            self.linked[-1] &= linked or blank
        elif not blank:
            self._block = block
            self.texts.append(text)
            self.owner.append(owner)
            self.linked.append(linked)

    def decoded(self) -> list[str]:
        """The blocks' texts."""
        return [" ".join(unescape(t).split()) for t in self.texts]


def ratios(page: Page, texts: list[str]) -> np.ndarray:
    """The smoothed and fused text and punctuation ratio of each block, times the factor of its marks."""
    kind = _kinds(page)
    size = np.array([len(t) for t in texts], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for t in texts], float)
    n = np.bincount(kind)
    smooth = lambda x: np.convolve(np.concatenate([x[:1], x, x[-1:]]), SMOOTHING, "valid")
    factor = np.array([page.mark[e] for e in page.owner])
    return smooth((np.bincount(kind, size) / n)[kind]) * (1.0 + smooth((np.bincount(kind, marks) / n)[kind])) * factor


def _kinds(page: Page) -> np.ndarray:
    """A number for each block, equal for blocks of one tag path and factor."""
    known: dict = {}
    return np.array([known.setdefault((page.path[e], page.mark[e]), len(known)) for e in page.owner])


def content(page: Page, texts: list[str], fused: np.ndarray) -> np.ndarray:
    """Whether each block's path is content: its mean ratio reaches the threshold that the
    unmarked blocks set."""
    size = np.array([len(t) for t in texts], float)
    plain = np.array([page.mark[e] == 1.0 for e in page.owner]) & (size > 0)
    if not plain.any():
        return np.zeros(len(texts), bool)
    threshold = max(SPREAD * fused[plain].std(), SHARE * np.average(fused[plain], weights=size[plain]))
    kind = _kinds(page)
    score = (np.bincount(kind, fused) / np.bincount(kind))[kind]
    return (score >= min(threshold, score[plain].max())) & (size > 0)


def belonging(page: Page, chosen: np.ndarray) -> np.ndarray:
    """Whether each block is written, given those on content paths."""
    held = np.zeros(len(page.tag), int)                           # content blocks in each element
    for e in np.array(page.owner)[chosen].tolist():
        held[e] += 1
    for e in range(len(held) - 1, 0, -1):                         # parents come before children
        held[page.parent[e]] += held[e]
    place, home = [0] * len(page.tag), [0] * len(page.tag)        # the nearest element that holds blocks; that is an article
    for e in range(1, len(place)):
        up = page.parent[e]
        place[e] = e if page.tag[e] in PLACES else place[up]
        home[e] = e if page.tag[e] in ("article", "main") else home[up]
    out = chosen.copy()
    after = False                                                 # the next block is content, or a heading before some
    at = np.flatnonzero(chosen)
    for i in range(len(out) - 1, -1, -1):
        e = page.owner[i]
        heading = page.tag[e] in HEADINGS
        if not chosen[i] and page.mark[e] == 1.0 and not (page.linked[i] and page.tag[e] in ("li", "ul", "ol")):
            if home[e] and held[home[e]]:
                out[i] = True
            elif held[place[e]]:
                out[i] = page.tag[place[e]] not in WHOLE or at[0] < i < at[-1]
            out[i] |= heading and after
        after = bool(chosen[i] or heading and after)
    return out


def main_text(html: str | None) -> str:
    """The main text of a page."""
    for forms in (False, True):
        page = Page(html or "", forms)
        texts = page.decoded()
        if page.owner:
            chosen = content(page, texts, ratios(page, texts))
            if chosen.any():
                return "\n".join([t for t, kept in zip(texts, belonging(page, chosen)) if kept and t])
    return ""


def extract(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each page. A column named ``out`` is replaced."""
    return with_columns(df, html_col, lambda: lambda pages: [[main_text(p) for p in pages]],
                        [T.StructField(out, T.StringType(), False)])
