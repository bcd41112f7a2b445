"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, threshold clusters.

The standard library's streaming parser turns a page into lines, one per block of text, with the tags seen on each.
A line's ratio is its code points outside links for each tag. Ratios are smoothed with a Gaussian along the page; lines
above the standard deviation of the smoothed ratios form clusters. The clusters decide twice. First, which declarations to
believe: a container can declare itself as something else than the article (menus, headers, footers, side bars, notices,
adverts, forms, comments, by element, role or class), but where such containers hold all but a tenth of the page's
clustered text, the one that holds most is a wrapper of the page and its declaration is dropped. Then clusters vote with
their text for the container they stand in, and the winner is the content region: all its lines outside containers whose
declaration stands, short ones too, are the main text.

A class or id declares only as a whole token: ``header`` and ``site-header`` do, ``header-wide`` and ``notice-board`` do not; numbers and
sizes in a token say nothing. Every element can declare itself: a paragraph, list item, heading or cell is a container of its own if
it does, and what stands in a declared inline element is left out of its line. Tags
that HTML lets authors leave out are implied: content ends an open head, blocks end an open button, option list, title or declared paragraph, an
item ends the one before.

Pages are independent, so the plan is one narrow map over them: no shuffle, no key, nothing larger than a page.

Defined cases: a null or empty page, or one without text, gives the empty string; broken markup (missing end tags,
stray ones, an unfinished tag or comment) is read as the parser reads it; rows are handled one by one, so repeated rows
keep a row each; an empty table gives an empty result; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seamline.llm.common import arrow_map

# Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var del".split())
MUTE = frozenset("script style noscript template svg math iframe object audio video canvas select textarea button head title map".split())
OTHER = frozenset("nav header footer aside form dialog menu".split())
ARTICLE = frozenset(("article", "main"))
SCOPES = frozenset("article main section div td table ul ol dl figure blockquote body html nav header footer aside form dialog menu details fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu footer header "
    "breadcrumb breadcrumbs comment comments disqus replies reply cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended widget pagination pager toolbar masthead skip alert "
    "sponsored subnav topnav topbar navbox commentlist responses".split()
)
#: Words that may stand beside one of the others in a token without changing what it says.
PLACE_WORDS = frozenset("site page top bottom left right main global primary secondary block box area section container wrapper inner list item items bar slot unit user reader article post posts list thread buttons links content google".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies responses disqus".split())
#: Elements that hold lines and are containers only if they declare themselves, and what ends one that is open.
HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address tr summary figcaption".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}
IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: Elements that a block of the page ends, should they still be open.
SHORT = frozenset("button select textarea title map head".split())
BLOCKS = SCOPES | frozenset("p h1 h2 h3 h4 h5 h6 pre address hr".split())
#: Containers that are parts of a text and never the whole of it.
PARTS = frozenset("blockquote figure ul ol dl table details".split())
#: Words of a token, without the numbers that end them; and sizes, which are none.
WORD = re.compile(r"[a-z]+")
SIZE = re.compile(r"\d+x\d+")

SIGMA = 1.0
#: Share of the clusters' text that a container has to hold on pages without an article or main element.
MOST = 0.8
#: Share of the clusters' text outside declared containers from which all declarations are believed.
LEAST = 0.1


def declares(token: str, words: frozenset = OTHER_WORDS) -> bool:
    """Whether a class token says, by all its words, that its container is one of ``words``."""
    parts = set(WORD.findall(SIZE.sub("-", token)))
    return not parts.isdisjoint(words) and parts <= words | PLACE_WORDS


def said(tag: str, attrs) -> tuple[bool, bool]:
    """Whether an element's attributes declare it as something else than the article, and whether they hide it."""
    own = hidden = False
    if tag not in ("html", "body"):
        for name, value in attrs:
            value = (value or "").strip().lower()
            if name in ("class", "id"):
                tokens = value.split()
                words = COMMENT_WORDS if tag in ARTICLE or not CONTENT_WORDS.isdisjoint(tokens) else OTHER_WORDS
                own |= any(declares(t, words) for t in tokens)
            elif name == "role":
                own |= value in OTHER_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
    return own, hidden


class Scope:
    """An open container: its place in the page, its parent, and what it means for the lines in it."""

    __slots__ = ("article", "mute", "own", "parent", "tag")

    def __init__(self, tag: str, parent: Scope | None, attrs):
        self.tag, self.parent = tag, parent
        self.mute = tag in MUTE or bool(parent and parent.mute)
        own, hidden = said(tag, attrs)
        self.own = own or tag in OTHER  # declares itself as something else than the article
        self.mute |= hidden
        self.article = parent.article if parent else None
        if tag in ARTICLE and self.article is None:
            self.article = self

    def chain(self):
        scope = self
        while scope is not None:
            yield scope
            scope = scope.parent


class Lines(HTMLParser):
    """Collects (text, tags, link characters, scope) for each block of text, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, Scope]] = []
        self.stack = [Scope("", None, ())]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.inside: list[str] = []  # open inline elements from the first that declares itself on: their text is left out

    def flush(self):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1]))
        self.parts, self.linked, self.inside = [], 0, []
        self.tags = 0

    def imply(self, tag: str):
        """End what a start tag or text outside of it cannot be inside of."""
        if self.stack[-1].tag == "p" and tag in BLOCKS | HOLDERS:
            self.flush()
            self.stack.pop()
        for k in range(len(self.stack) - 1, 0, -1) if tag in ENDS else ():
            if self.stack[k].tag in ENDS[tag]:
                self.flush()
                del self.stack[k:]
            if k >= len(self.stack) or self.stack[k].tag in SCOPES:
                break
        while self.stack[-1].tag in SHORT and (tag not in IN_HEAD if self.stack[-1].tag == "head" else tag in BLOCKS):
            self.flush()
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        self.imply(tag)
        if tag in INLINE:
            self.tags += 1
            self.links += tag == "a"
            if self.inside or (attrs and any(said(tag, attrs))):
                self.inside.append(tag)
            return
        self.flush()
        self.tags += 1
        if tag not in VOID and (tag in SCOPES or tag in MUTE or (tag in HOLDERS and (any(o.tag == tag for o in self.stack) or (attrs and any(said(tag, attrs)))))):
            self.stack.append(Scope(tag, self.stack[-1], attrs))

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
            return
        self.flush()
        self.links = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            if tag not in INLINE:
                self.flush()
        else:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and not data.isspace():
            self.imply("p")
        if not self.stack[-1].mute and not self.inside:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def read(self, html: str):
        self.feed(html)
        self.close()
        self.flush()
        return self.lines


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratio, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def believed(lines, dense: list[int]) -> set[Scope]:
    """Containers whose declaration stands, given the clustered lines."""
    scopes = {s: None for _, _, _, scope in lines for s in scope.chain()}
    stands = {s for s in scopes if s.own}
    weight = {i: len(lines[i][0]) - lines[i][2] for i in dense}
    total = sum(weight.values())
    while total:
        outside, votes = 0, {}
        for i, w in weight.items():
            inside = [s for s in lines[i][3].chain() if s in stands]
            if inside:
                votes[inside[-1]] = votes.get(inside[-1], 0) + w  # the outermost
            else:
                outside += w
        if outside >= LEAST * total or not votes:
            break
        stands.discard(max(votes, key=votes.get))
    return stands


def main_text(html: str | None) -> str:
    lines = Lines().read(html or "")
    lines = [x for x in lines if not x[3].mute]
    if not lines:
        return ""
    level = smooth(np.array([(len(t) - linked) / max(1, tags) for t, tags, linked, _ in lines]))
    dense = np.flatnonzero(level >= level.std()).tolist()
    stands = believed(lines, dense)
    free = [stands.isdisjoint(s.chain()) for _, _, _, s in lines]
    # Clusters of the lines that are left: those of the others no longer count, neither by themselves nor as neighbours.
    level = smooth(np.array([f * (len(t) - linked) / max(1, tags) for f, (t, tags, linked, _) in zip(free, lines, strict=True)]))
    dense = [i for i in np.flatnonzero(level >= level.std()).tolist() if free[i]] or np.flatnonzero(free).tolist()
    votes: dict[Scope, int] = {}
    articles: dict[Scope, int] = {}
    for i in dense:
        text, _, _, scope = lines[i]
        if scope.article is not None:
            articles[scope.article] = articles.get(scope.article, 0) + len(text)
        for s in scope.chain():
            votes[s] = votes.get(s, 0) + len(text)
    if articles:
        region = max(articles, key=articles.get)
    elif votes:
        total = max(votes.values())
        region = max((s for s, v in votes.items() if v >= MOST * total and s.tag not in PARTS), key=lambda s: (sum(1 for _ in s.chain()), -votes[s]))
    else:
        return ""
    return " ".join(t for (t, _, _, s), f in zip(lines, free, strict=True) if f and region in s.chain())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by ``text`` and ``n_chars``; all other columns stay."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(html)]
            arrays = [batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])

    return arrow_map(pages.select(*keep, html), run, schema, rows=256)
