"""Main text of HTML pages by tag-path ratios.

A page becomes a list of text leaves, each with its root-to-leaf path of tags
(with class names and ids). For every path the lengths and the punctuation of its
leaves are summed. Two features per path, mean text length per leaf and mean
punctuation per leaf, are smoothed along the page over neighbouring leaves, fused
by multiplication and compared with the page's own threshold (a share of the
length-weighted mean). Leaves of passing paths are content.

Tags and names that say what they hold are used as well: paths through scripts,
menus, footers, forms, adverts, comments and the like never pass; if the page has
an article or main element whose paths hold the content, every path in it that is
not ruled out passes, so short paragraphs and headings are kept.

Class names and ids are also put on wrappers of the whole page. A name rules
nothing out where the element holds a main, more text of articles than is left
outside of such names, or, on pages without either, most of the page's text. It
only lowers the features of the paths through the element then.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import travels_with_tasks, whole

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
BLANKS = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

# Elements whose text is no text of the page.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "iframe",
                 "xmp", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                  "param", "source", "track", "wbr"])
INLINE = frozenset(["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data",
                    "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q",
                    "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub",
                    "sup", "time", "tt", "u", "var", "wbr", "img"])
# These end an open paragraph.
ENDS_P = frozenset(["address", "article", "aside", "blockquote", "center", "details", "dialog",
                    "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
                    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu",
                    "nav", "ol", "p", "pre", "search", "section", "table", "ul"])
# An element of the first kind ends an open one of the second kinds.
SAME_LEVEL = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
    "tfoot": ("tbody", "tr", "td", "th"),
}
BARRIER = frozenset(["ul", "ol", "dl", "table", "select", "body", "html", "menu"])
FENCE = frozenset(["article", "main", "body", "html"])

NOT_CONTENT_TAGS = frozenset(["nav", "footer", "aside", "form", "button", "select", "head",
                              "menu", "dialog", "object", "svg", "canvas", "search",
                              "audio", "video", "map"])
NOT_CONTENT_NAMES = re.compile(
    r"(?<!has-)(?<!with-)(?<!no-)(?<![a-z0-9])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*"
    r"|breadcrumb\w*|footer\w*|foot|masthead|topbar|side|sidebar\w*|aside|rail|widget\w*"
    r"|cookie\w*|consent\w*|notice\w*|gdpr|popup\w*|modal\w*|overlay|alert\w*|comment\w*|replies"
    r"|reply|respond|disqus\w*|discussion|related\w*|recommend\w*|share\w*|sharing|social\w*"
    r"|subscribe\w*|newsletter\w*|signup|login|search\w*|pagination|pager|toolbar|tags?|toc"
    r"|skip\w*|hidden|copyright|legal|feedback)(?:$|[-_ ])", re.I
)
PAGE_HEADER = re.compile(r"(?:^|[-_ ])header(?:$|[-_ ])", re.I)
# Anything else ends an open head.
HEAD_TAGS = frozenset(["base", "link", "meta", "noscript", "script", "style", "template", "title"])
CONTENT_TAGS = frozenset(["article", "main"])
NOT_CONTENT_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search",
                               "form", "dialog", "alert", "menu", "menubar"])
# Classes that list a post's tags, on the post itself.
TAXONOMY = re.compile(r"(?:^|(?<= ))(?:tags?|category)-[^ ]+", re.I)
SMOOTHING = 2
THRESHOLD = 0.3
NAMED_RATIO = 0.5


@dataclass(frozen=True)
class Named:
    """Elements on a path whose names say that they hold no content.

    Each by its place and whether it stands in an article or main. The first ``homes`` of them lie around an article or main, the first ``mains``
    around a main.
    """

    places: tuple[tuple[int, bool], ...] = ()
    homes: int = 0
    mains: int = 0


@dataclass
class Element:
    tag: str
    step: str
    out: bool
    inside: bool
    named: Named = Named()
    block: int = 0


@dataclass
class Leaf:
    path: str
    text: str
    block: int
    out: bool
    inside: bool
    named: Named = Named()
    fused: float = field(default=0.0)


def _attributes(source: str) -> dict[str, str]:
    found = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def _element(tag: str, source: str, above: Element | None, place: int) -> Element:
    attributes = _attributes(source) if "=" in source else {}
    names = " ".join(attributes.get(k, "") for k in ("class", "id")).strip()
    role = attributes.get("role", "").lower()
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", source, re.I)) or (
        attributes.get("aria-hidden", "").lower() == "true"
        or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden",
                          attributes.get("style", ""), re.I))
    )
    content = tag in CONTENT_TAGS or role in ("main", "article") or (
        attributes.get("itemprop", "").lower() == "articlebody"
    )
    inside = bool(above and above.inside)
    out = (
        tag in NOT_CONTENT_TAGS or tag in RAW or role in NOT_CONTENT_ROLES or hidden
        # a page header is none of the article, the one within it may hold its heading
        or tag == "header" and not inside
    )
    named = above.named if above else Named()
    if content and (tag == "main" or role == "main"):
        named = Named(named.places, len(named.places), len(named.places))
    elif content and not NOT_CONTENT_NAMES.search(TAXONOMY.sub("", names)):
        # articles named as comments, teasers and the like speak for nothing around them
        named = Named(named.places, len(named.places), named.mains)
    if tag not in ("html", "body", *CONTENT_TAGS) and (
        NOT_CONTENT_NAMES.search(names) or PAGE_HEADER.search(names) and not inside
    ):
        named = Named((*named.places, (place, inside)), named.homes, named.mains)
    return Element(
        tag, tag + "".join("." + n for n in names.split()),
        out or bool(above and above.out), content or inside, named,
    )


def leaves(page: str) -> Iterator[Leaf]:
    """The text leaves in page order; unclosed and stray tags are put up with."""
    stack: list[Element] = []
    block, at, size, lowered = 0, 0, len(page), None

    def leaf(text: str) -> Leaf:
        top = stack[-1] if stack else Element("", "", False, False)
        path = "/".join(e.step for e in stack)
        return Leaf(path, text, block, top.out, top.inside, top.named)

    def text(start: int, end: int) -> Iterator[Leaf]:
        if end > start and (raw := page[start:end]) and not raw.isspace():
            yield leaf(html.unescape(raw))
        elif end > start:
            yield leaf(" ")

    while at < size:
        found = TAG.search(page, at)
        if not found:
            # a lone "<" that opens no tag is text
            yield from text(at, size)
            break
        yield from text(at, found.start())
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            close = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag
                          or stack[i].tag in FENCE and tag not in FENCE), None)
            if close is not None and stack[close].tag == tag:
                if any(e.tag not in INLINE for e in stack[close:]):
                    block += 1
                del stack[close:]
            elif tag == "p":
                block += 1
            continue
        if tag not in INLINE and tag != "br":
            block += 1
        if stack and stack[-1].tag == "head" and tag not in HEAD_TAGS:
            stack.pop()
        if tag == "br":
            yield leaf(" ")
        if tag in VOID:
            continue
        if tag in ENDS_P:
            _close(stack, ("p",), BARRIER | {"li", "td", "th", "button", "object"} | FENCE)
        elif tag in SAME_LEVEL:
            _close(stack, SAME_LEVEL[tag], BARRIER | FENCE)
        element = _element(tag, found[3] or "", stack[-1] if stack else None, at)
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at) if len(lowered) == size else page.find(f"</{tag}", at)
            at = size if end < 0 else end
            if end >= 0:
                at = (page.find(">", end) + 1) or size
            continue
        if not (found[3] or "").rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(element)


def _close(stack: list[Element], tags: tuple[str, ...], barrier: frozenset[str]) -> None:
    lowest = None
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in tags:
            lowest = i
        elif stack[i].tag in barrier:
            break
    if lowest is not None:
        del stack[lowest:]


def wrappers(found: list[Leaf]) -> set[tuple[int, bool]]:
    """The named elements whose names don't rule out what they hold.

    With an element those around it are wrappers as well.
    """
    texts = [x for x in found if not x.out and not x.text.isspace()]
    kept: set[tuple[int, bool]] = set()
    if not any(x.named.places for x in texts):
        return kept
    homes: dict[tuple, int] = defaultdict(int)
    direct: dict[tuple, int] = defaultdict(int)
    held: dict[tuple, int] = defaultdict(int)
    around: dict[tuple, tuple] = {}
    for x in texts:
        size, places = len(x.text), x.named.places
        for i, place in enumerate(places):
            held[place] += size
            around[place] = places[: i + 1]
            if i < x.named.homes:
                homes[place] += size
            if i < x.named.mains:
                kept.add(place)
        if places:
            direct[places[-1]] += size

    def text_of_homes() -> int:
        return sum(len(x.text) for x in texts if x.inside
                   and all(p in kept for p in x.named.places if not p[1]))

    def text_left() -> int:
        return sum(len(x.text) for x in texts if kept.issuperset(x.named.places))

    open_homes = text_of_homes()
    for place in sorted(homes, key=lambda p: (-homes[p], p)):
        if place not in kept and homes[place] > open_homes:
            kept.update(around[place])
            open_homes = text_of_homes()
    total = sum(len(x.text) for x in texts)
    open_text = text_left()
    for place in sorted(p for p in held if 2 * held[p] > total):
        # with an article or main in the open only what stands in one
        if place not in kept and direct[place] > open_text and (place[1] or not open_homes):
            kept.update(around[place])
            open_text = text_left()
    return kept


def content_leaves(page: str) -> list[Leaf]:
    """The leaves that hold content, by tag-path ratios and names."""
    found = list(leaves(page))
    kept = wrappers(found)
    for leaf in found:
        leaf.out = leaf.out or not kept.issuperset(leaf.named.places)
    open_leaves = [x for x in found if not x.out and not x.text.isspace()]
    if not open_leaves:
        return []
    length: dict[str, int] = defaultdict(int)
    marks: dict[str, int] = defaultdict(int)
    count: dict[str, int] = defaultdict(int)
    for leaf in open_leaves:
        length[leaf.path] += len(leaf.text)
        marks[leaf.path] += len(PUNCTUATION.findall(leaf.text))
        count[leaf.path] += 1
    texts = [length[x.path] / count[x.path] for x in open_leaves]
    points = [1 + marks[x.path] / count[x.path] for x in open_leaves]
    for i, leaf in enumerate(open_leaves):
        near = slice(max(0, i - SMOOTHING), i + SMOOTHING + 1)
        window = len(open_leaves[near])
        leaf.fused = sum(texts[near]) * sum(points[near]) / window**2
        if leaf.named.places and not leaf.inside:
            leaf.fused *= NAMED_RATIO
    weights = [len(x.text) for x in open_leaves]
    limit = THRESHOLD * sum(w * x.fused for w, x in zip(weights, open_leaves)) / sum(weights)
    # a path passes as a whole, by its best leaf
    best: dict[str, float] = defaultdict(float)
    for leaf in open_leaves:
        best[leaf.path] = max(best[leaf.path], leaf.fused)
    passing = {path for path, fused in best.items() if fused >= limit}
    inside = sum(w for w, x in zip(weights, open_leaves) if x.inside)
    if 2 * inside >= sum(weights) or any(x.inside for x in open_leaves if x.path in passing):
        passing = {x.path for x in open_leaves if x.inside}
    return [x for x in found if not x.out and (x.path in passing or x.text.isspace())]


def main_text(page: str | None) -> str:
    """Content blocks in page order, a line feed between any two; empty if none.

    White space within a block becomes one space and is trimmed. Null and empty
    pages have no text.
    """
    if not page:
        return ""
    blocks: dict[int, list[str]] = defaultdict(list)
    for leaf in content_leaves(page):
        blocks[leaf.block].append(leaf.text)
    lines = (BLANKS.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    Each page is worked on alone and whole. Repeated rows are extracted each;
    other columns are not read.
    """
    @F.pandas_udf(T.StringType())
    def extract(found: pd.Series) -> pd.Series:
        return found.map(main_text)

    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url).alias("url"),
        extract(whole(source)).alias("text"),
    ).withColumn("n_chars", F.length("text").cast("bigint"))


travels_with_tasks(__name__)
