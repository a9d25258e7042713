"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by link density, length and stop-word
density: link-heavy ones are bad, long ones with the language's stop words good, others undecided (near: long but without
stop words; short). Runs of three and more items that are links are menus. On a page where no block has stop words, length and
links decide alone. In the second pass undecided blocks inherit the label of the nearest decided neighbour; a heading looks
ahead on a tie.

What the markup says is evidence for which blocks take part: first those in the page's article that lie in no container that
its tag, role, style or class words call a menu, header, footer, sidebar, notice, advert, form or comments. If nothing of these is
kept, those outside the article take part, and then those that only class words call boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .quality import STOP_WORDS

SHORT_CHARS, LONG_CHARS = 70, 200
STOPS_GOOD, STOPS_NEAR = 0.20, 0.10
#: So many items in a row that are links make a menu.
MENU_ITEMS = 3
LINKS_BAD, LINKS_BAD_IN_ARTICLE = 0.2, 0.6

# Element names of the HTML standard, and words that sites use in class and id attributes.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select object".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements of the above whose content is markup: one that is never closed does not hide the rest of the page.
MARKUP_INSIDE = frozenset("noscript svg math select object".split())
#: What may stand in a head; anything else ends it.
METADATA = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button search head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu submenu sidebar sidenav aside footer header masthead topbar breadcrumb breadcrumbs ad ads advert adverts "
    "advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup signin login register share sharing social comment comments disqus reply replies respond "
    "related recommended recommendations widget toolbar pagination pager search form skip".split()
)
HEADINGS, ITEMS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li dt dd td th".split())
#: Containers whose class words say nothing about all that they hold.
WHOLE = frozenset("html body main article".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}),
             "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_EDGES = re.compile(r"^\W+|\W+$")


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    main: bool = False
    #: How sure the markup is that the block is boilerplate: 0 not at all, 1 by class words, 2 by tag, role or style.
    aside: int = 0
    heading: bool = False
    item: bool = False
    text: str = ""
    #: Share of its characters that are in links.
    links: float = 0.0
    label: str = ""


def boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """How sure a container's markup is that it holds no main text: 0, 1 (class words) or 2. A header inside an article is the article's own."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return 2
    if not attributes.strip():
        return 0
    words: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return 2
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return 2
        if name in ("class", "id"):
            words += value.lower().split()
    if tag in WHOLE and not (tag == "article" and in_article):
        return 0
    for word in words:
        pieces = re.split(r"[-_]+", word)
        if pieces[0] in ("has", "no", "with", "without", "js") or (in_article and pieces[-1] == "header"):
            continue
        if pieces[0] in BOILERPLATE_WORDS or pieces[-1] in BOILERPLATE_WORDS:
            return 1
    return 0


class _Open:
    """The open elements of a page: the depths of each tag, of blocks, and of the outermost containers that matter."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.article = self.link = -1
        self.asides = [-1, -1, -1]  # outermost boilerplate containers by how sure the markup is
        self.aside = 0  # the surest of them

    def push(self, tag: str, aside: int, article: bool) -> None:
        depth = len(self.tags)
        self.tags.append(tag)
        self.depths.setdefault(tag, []).append(depth)
        if tag in BLOCKS:
            self.blocks.append(depth)
        if aside and self.asides[aside] < 0:
            self.asides[aside] = depth
            self.aside = max(self.aside, aside)
        if article and self.article < 0:
            self.article = depth
        if tag == "a" and self.link < 0:
            self.link = depth

    def close(self, depth: int) -> None:
        for at in range(len(self.tags) - 1, depth - 1, -1):
            self.depths[self.tags.pop()].pop()
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()
        if self.article >= depth:
            self.article = -1
        if self.link >= depth:
            self.link = -1
        if self.aside:
            self.asides = [-1 if x >= depth else x for x in self.asides]
            self.aside = max((k for k, x in enumerate(self.asides) if x >= 0), default=0)

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of a tag; -1 without one."""
        return at[-1] if (at := self.depths.get(tag)) else -1


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order, with what the markup says of them."""
    out, now, at = [], Block(), 0
    stack = _Open()

    def flush(opened: str = "") -> None:
        nonlocal now
        if now.parts:
            said = "".join(now.parts).split()
            if said:
                now.text = " ".join(said)
                if now.linked:
                    now.links = now.linked / (len(now.text) - len(said) + 1)
                out.append(now)
        now = Block(main=stack.article >= 0, aside=stack.aside, heading=opened in HEADINGS, item=opened in ITEMS)

    def say(chunk: str) -> None:
        if stack.tags and stack.tags[-1] == "head" and chunk.strip():
            stack.close(len(stack.tags) - 1)
            now.aside = stack.aside
        if chunk:
            said = unescape(chunk) if "&" in chunk else chunk
            now.parts.append(said)
            if stack.link >= 0:
                now.linked += sum(map(len, said.split()))

    size = len(html)
    while at < size:
        m = _MARKUP.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            depth = stack.last(tag)
            before = stack.aside
            if tag in BLOCKS:
                flush()
            if depth >= 0:
                stack.close(depth)
                if stack.aside != before:
                    flush()
                now.main, now.aside = stack.article >= 0, stack.aside
            continue
        if stack.tags and stack.tags[-1] == "head" and tag not in METADATA:
            stack.close(len(stack.tags) - 1)
            now.aside = stack.aside
        if tag in RAW and not attributes.endswith("/"):
            end = _raw_end(tag).search(html, at)
            if end is None:
                if tag in MARKUP_INSIDE:
                    continue
                break
            at = end.end()
            continue
        if tag in BLOCKS:
            flush(tag)
        if tag in VOID or attributes.endswith("/"):
            continue
        if stack.blocks and tag in CLOSED_BY.get(stack.tags[stack.blocks[-1]], ()):
            stack.close(stack.blocks[-1])
        aside, article = boilerplate(tag, attributes, stack.article >= 0), tag in ("article", "main") or 'role="main"' in attributes
        if aside > stack.aside and tag not in BLOCKS:
            flush()
        stack.push(tag, aside, article)
        now.main, now.aside = stack.article >= 0, stack.aside
    flush()
    return out


def stop_words(text: str, enough: float) -> float:
    """The share of a text's words that are stop words, signs around them aside; a lower bound of it if that is enough."""
    words = text.lower().split()
    bare = sum(map(STOP_WORDS.__contains__, words)) / len(words)
    return bare if bare >= enough else sum(w in STOP_WORDS for w in (_EDGES.sub("", w) for w in words)) / len(words)


def classify(block: Block) -> str:
    """First pass: good, near, short or bad."""
    n = len(block.text)
    if block.links > (LINKS_BAD_IN_ARTICLE if block.main else LINKS_BAD):
        return "bad" if not block.main or n >= SHORT_CHARS and not block.item else "short"
    if n < SHORT_CHARS:
        return "short"
    stops = stop_words(block.text, STOPS_NEAR if block.main else STOPS_GOOD)
    if stops >= (STOPS_NEAR if block.main else STOPS_GOOD):
        return "good" if block.main or n > LONG_CHARS else "near"
    return "near" if block.main or stops >= STOPS_NEAR or n > LONG_CHARS else "bad"


def first_pass(blocks: list[Block]) -> None:
    """Labels blocks one by one, then menus, and all that is near on a page without stop words."""
    for b in blocks:
        b.label = classify(b)
    run: list[Block] = []
    for b in [*blocks, Block()]:
        if b.item and b.links > LINKS_BAD_IN_ARTICLE:
            run.append(b)
        else:
            if len(run) >= MENU_ITEMS:
                for x in run:
                    x.label = "bad"
            run = []
    if not any(b.label == "good" for b in blocks):
        for b in blocks:
            if b.label == "near":
                b.label = "good"


def settle(labels: list[str], headings: list[bool], alone: bool) -> list[bool]:
    """Second pass: undecided blocks take the nearest decided label; without any, ``alone``."""
    n = len(labels)
    decided = [k for k in range(n) if labels[k] in ("good", "bad")]
    out, place = [], 0
    for k in range(n):
        if labels[k] in ("good", "bad"):
            out.append(labels[k] == "good")
            place += 1
            continue
        back = decided[place - 1] if place else None
        ahead = decided[place] if place < len(decided) else None
        if back is None and ahead is None:
            out.append(alone)
        elif back is None or ahead is None:
            out.append(labels[back if ahead is None else ahead] == "good")
        elif labels[back] == labels[ahead] or k - back < ahead - k:
            out.append(labels[back] == "good")
        elif ahead - k < k - back or headings[k]:
            out.append(labels[ahead] == "good")
        else:
            out.append(labels[k] == "near")
    return out


def main_text(html: str | None) -> str:
    """The main text of a page; empty for a null or empty page or one without any."""
    if not html:
        return ""
    every = blocks_of(html)
    for part in ([b for b in every if b.main and not b.aside], [b for b in every if not b.aside], [b for b in every if b.aside < 2]):
        first_pass(part)
        # Without any decided block, short ones are all that there is.
        keep = settle([b.label for b in part], [b.heading for b in part], True)
        if any(keep):
            return " ".join(b.text for b, k in zip(part, keep) if k)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row per page, whole main text and its code points.

    A null page has an empty text. Ids and urls may be null or repeated. Other columns are ignored.
    """
    bounded_batches(pages.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    picked = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").cast("string"))
    return picked.mapInArrow(rows, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
