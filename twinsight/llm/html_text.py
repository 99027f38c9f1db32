"""Main text of web pages: flat text blocks, features of each and its neighbours, a small decision tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsight.llm.text import col

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# HTML element kinds.
DROPPED = set("script style noscript template svg math head title iframe object select textarea button canvas audio video".split())
CONTAINERS = set(
    "html body div section article main nav header footer aside form ul ol dl menu table figure details dialog fieldset blockquote".split()
)
#: Dropped elements whose content is characters, not tags, up to their end tag; those of them that hold no code.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea".split()}
RAW_TEXT = {"title", "textarea"}
HEAD_TAGS = set("head title meta link base basefont bgsound style script noscript noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
EDGE_TAGS = set("nav header footer aside form menu dialog fieldset".split())
MAIN_TAGS = set("article main".split())
EDGE_NAMES = set(
    "nav navbar navigation menu sidebar side header masthead footer ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies "
    "consent notice alert comment comments respond reply related share social breadcrumb breadcrumbs subscribe newsletter widget popup modal login "
    "search pagination pager toolbar tags meta copyright disqus".split()
)
#: Names that make an article or main element the work of readers; other edge names say nothing against such an element.
READER_NAMES = set("comment comments respond reply disqus".split())
#: Elements that hold the whole page: their names are about its layout.
PAGE_TAGS = set("html body".split())
MAIN_NAMES = set("article content main post entry story text".split())

MAIN, PLAIN, EDGE = 1, 0, -1


@dataclass
class Block:
    """A run of text between block-level tags."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    context: int = PLAIN
    heading: bool = False
    text: str = ""
    words: int = 0


def _context(tag: str, attributes: str) -> int:
    """What an element says of the text in it. Names outweigh the tag, but not that of an article, nor do they speak for a whole page."""
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        key = m[1].lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return EDGE
        if key in ("class", "id", "role"):
            names |= {value, *re.split(r"[^a-z0-9]+", value)}
    if tag in PAGE_TAGS:
        return PLAIN
    if tag in MAIN_TAGS:
        return EDGE if names & READER_NAMES else MAIN
    if tag in EDGE_TAGS or names & EDGE_NAMES:
        return EDGE
    return MAIN if names & MAIN_NAMES else PLAIN


@dataclass
class Tag:
    """A tag of a page; ``end`` is the index of the end tag that belongs to a dropped element's start tag."""

    start: int
    stop: int
    name: str
    closing: bool
    attributes: str
    end: int | None = None


def page_tags(html: str) -> list[Tag]:
    """Tags in order, comments as tags without a name. Content of raw-text elements is not looked into.

    A script or style that is never closed takes the rest of the page, as in browsers.
    """
    tags: list[Tag] = []
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()
    at = 0
    while m := _TAG.search(html, at):
        at = m.end()
        tag = Tag(m.start(), at, (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or "")
        tags.append(tag)
        if tag.name not in DROPPED:
            continue
        if tag.closing:
            if opened.get(tag.name):
                tags[opened[tag.name].pop()].end = len(tags) - 1
        elif not tag.attributes.endswith("/"):
            if tag.name in RAW and tag.name not in endless:
                end = RAW[tag.name].search(html, at)
                if end:
                    at = end.start()
                elif tag.name in RAW_TEXT:
                    endless.add(tag.name)
                else:
                    break
            opened.setdefault(tag.name, []).append(len(tags) - 1)
    return tags


def text_blocks(html: str) -> list[Block]:
    """Blocks of a page in order; dropped elements, comments and markup leave nothing behind.

    A dropped element ends at its end tag or where the container around it closes. Without an end tag it is
    empty; a head ends at the first tag or text that cannot stand in it.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, int]] = []  # open containers and the nearest hint at or above each
    inner: list[str] = []  # open containers inside a dropped element
    held, held_inside = Counter(), Counter()  # how many of each tag are in them, so that a stray end tag costs no search
    block, links, dropped, at = Block(), 0, "", 0
    skip = -1  # tags up to this index belong to an element that stands in the head

    def close(heading: bool = False) -> Block:
        if block.parts:
            text = " ".join(unescape("".join(block.parts)).split())
            if text:
                block.text, block.words = text, text.count(" ") + 1
                blocks.append(block)
        return Block(context=stack[-1][1] if stack else PLAIN, heading=heading)

    tags = page_tags(html)
    for index, mark in enumerate(tags):
        if dropped == "head" and index > skip and mark.start > at and not html[at : mark.start].isspace():
            dropped = ""
        if not dropped and mark.start > at:
            piece = html[at : mark.start]
            block.parts.append(piece)
            if links:
                block.linked += len(piece.split())
        at = mark.stop
        tag, closing = mark.name, mark.closing
        if not tag:
            continue
        if dropped == "head":
            if index <= skip or closing and tag not in ("head", "body", "html"):
                continue
            if tag in HEAD_TAGS:
                dropped = "" if closing else dropped
                skip = mark.end or skip
                continue
            dropped = ""
        elif dropped:
            if index == skip:
                dropped = ""
                continue
            if tag not in CONTAINERS or not closing:
                if tag in CONTAINERS:
                    inner.append(tag)
                    held_inside[tag] += 1
                continue
            if held_inside[tag]:
                while True:
                    ended = inner.pop()
                    held_inside[ended] -= 1
                    if ended == tag:
                        break
                continue
            if not held[tag]:
                continue
            dropped = ""
        if tag == "body" and not closing:
            links = 0
        if tag in DROPPED:
            if not closing and not mark.attributes.endswith("/"):
                if tag == "head":
                    dropped, skip = tag, -1
                elif mark.end is not None:
                    dropped, skip, inner, held_inside = tag, mark.end, [], Counter()
                elif tag in RAW and tag not in RAW_TEXT:
                    dropped, skip = tag, len(tags)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag in CONTAINERS:
            if not closing:
                block = close()
                hint = _context(tag, mark.attributes)
                stack.append((tag, hint or (stack[-1][1] if stack else PLAIN)))
                held[tag] += 1
            elif held[tag]:
                block = close()
                while True:
                    ended = stack.pop()[0]
                    held[ended] -= 1
                    if ended == tag:
                        break
            block = close()
            links = 0
            continue
        block = close(heading=not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
    if dropped == "head" and len(tags) - 1 >= skip and html[at:].strip():
        dropped = ""
    if not dropped and at < len(html):
        block.parts.append(html[at:])
    close()
    return blocks


#: Features of a block: words and link density of it, the one before and the one after; context; heading.
FEATURES = 8


def block_features(blocks: list[tuple[int, int, int, bool]]) -> np.ndarray:
    """From (words, linked words, context, heading) of each block of one page."""
    if not blocks:
        return np.empty((0, FEATURES))
    words = np.array([b[0] for b in blocks], "float64")
    density = np.array([b[1] for b in blocks]) / np.maximum(words, 1)
    before, after = np.concatenate([[0], words[:-1]]), np.concatenate([words[1:], [0]])
    density_before, density_after = np.concatenate([[0], density[:-1]]), np.concatenate([density[1:], [0]])
    return np.column_stack(
        [words, density, before, density_before, after, density_after, [b[2] for b in blocks], [b[3] for b in blocks]]
    )


#: The labelled table: page, context (main, plain, edge), h for headings, words, linked words, 1 if main text.
LABELLED = """
a edge - 1 1 0 | a edge - 2 2 0 | a edge - 1 1 0 | a edge - 8 0 0 | a main h 9 0 1 | a main - 120 0 1 | a main - 14 0 1 | a main - 2 0 1 | a main - 1 0 1 | a main - 60 3 1 | a edge - 12 0 0
b edge - 3 3 0 | b edge - 25 0 0 | b main h 5 0 1 | b main - 3 0 1 | b main - 80 10 1 | b main - 6 6 0 | b main - 40 0 1 | b edge - 30 2 0 | b edge - 55 0 0 | b edge - 4 2 0
c plain - 1 1 0 | c plain - 2 2 0 | c plain - 1 1 0 | c plain h 8 0 1 | c plain - 70 2 1 | c plain - 45 0 1 | c plain - 18 1 1 | c plain - 90 0 1 | c plain - 3 0 0 | c plain - 4 4 0 | c plain - 6 1 0
d plain - 5 5 0 | d plain - 3 3 0 | d plain h 6 0 1 | d plain - 35 0 1 | d plain - 5 0 1 | d plain - 50 4 1 | d plain - 12 0 1 | d plain - 64 0 1 | d plain - 2 2 0 | d plain - 7 0 0 | d plain - 3 3 0
e edge h 4 0 0 | e edge - 9 9 0 | e main h 11 0 1 | e main - 1 0 1 | e main - 1 0 1 | e main - 200 0 1 | e main - 7 0 1 | e main - 16 2 1 | e edge h 2 0 0 | e edge - 40 1 0 | e edge - 70 0 0 | e edge - 22 0 0
f edge - 60 0 0 | f main - 300 20 1 | f edge - 6 0 0 | f edge - 11 11 0 | f edge - 90 0 0 | f edge h 3 3 0 | f main - 33 0 1 | f main h 2 0 1 | f main - 10 9 0 | f main - 27 1 1
g plain h 3 3 0 | g plain - 4 3 0 | g plain - 28 0 1 | g plain - 41 0 1 | g plain - 30 28 0 | g plain - 25 22 0 | g plain - 100 3 1 | g plain - 5 0 0 | g plain - 8 6 0
i main h 7 0 1 | i main - 60 20 1 | i main - 20 8 1 | i main - 44 15 1 | i main - 9 3 1 | i main - 8 8 0 | i main - 12 11 0 | i main - 75 18 1 | i edge - 30 1 0
j plain - 2 0 0 | j plain - 4 0 0 | j plain - 50 12 1 | j plain - 38 9 1 | j plain - 64 15 1 | j plain - 20 0 1 | j plain - 16 0 1 | j plain - 9 0 0 | j plain - 3 0 0 | j plain - 5 0 0
k plain - 6 0 0 | k plain - 3 0 0 | k plain h 7 0 1 | k plain - 55 0 1 | k plain - 30 14 0 | k plain - 47 0 1 | k plain - 22 2 1 | k plain - 6 0 0 | k plain - 2 0 0 | k plain - 4 0 0
h edge - 15 3 0 | h main - 4 0 1 | h main - 2 0 1 | h main - 5 0 1 | h edge - 2 2 0 | h edge - 4 0 0
"""


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the table; neighbours are those on the same page."""
    rows, labels = [], []
    for page in LABELLED.strip().splitlines():
        cells = [r.split() for r in page.split("|")]
        context = {"main": MAIN, "plain": PLAIN, "edge": EDGE}
        rows.append(block_features([(int(c[3]), int(c[4]), context[c[1]], c[2] == "h") for c in cells]))
        labels += [int(c[5]) for c in cells]
    return np.concatenate(rows), np.array(labels)


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2):
    """A decision tree by Gini impurity: ``(feature, bound, tree if <= bound, tree above)`` or a share of label 1.

    Ties go to the earlier feature and the lower bound.
    """
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0) or len(labels) < 2 * least:
        return share
    best = (share * (1 - share) * len(labels) - 1e-9, None, None)
    for feature in (6, *(f for f in range(rows.shape[1]) if f != 6)):
        values = np.unique(rows[:, feature])
        for bound in (values[:-1] + values[1:]) / 2:
            low = rows[:, feature] <= bound
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(labels[part].mean() * (1 - labels[part].mean()) * part.sum() for part in (low, ~low))
            if impurity < best[0] - 1e-9:
                best = (impurity, feature, bound)
    if best[1] is None:
        return share
    low = rows[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow_tree(rows[low], labels[low], depth - 1, least), grow_tree(rows[~low], labels[~low], depth - 1, least)


def is_main(tree, row) -> bool:
    while isinstance(tree, tuple):
        feature, bound, low, high = tree
        tree = low if row[feature] <= bound else high
    return tree >= 0.5


def main_text(html: str | None, tree) -> str:
    """Texts of the blocks that the tree takes for main text, joined by one space; empty if none."""
    if not html:
        return ""
    blocks = text_blocks(html)
    rows = block_features([(b.words, b.linked, b.context, b.heading) for b in blocks]).tolist()
    return " ".join(b.text for b, row in zip(blocks, rows, strict=True) if is_main(tree, row))


def with_main_text(df: DataFrame, html: str = "html", target: str = "text") -> DataFrame:
    """``df`` with the main text of every whole page in ``target``; a column of that name is replaced.

    One scan, no shuffle; the tree (a few dozen numbers) is grown on the driver. Null and empty pages, and pages
    without main text, give an empty string. Rows are independent, so repeated rows give equal texts;
    an empty table gives an empty one. All other columns are kept.
    """
    tree = grow_tree(*labelled_rows())

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype="object")

    return df.withColumn(target, F.pandas_udf(extract, "string")(col(html)))
