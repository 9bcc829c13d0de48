"""Main text of web pages by minimum-cut labelling.

A page becomes the sequence of its text blocks.  A small classifier gives each
block log odds of being content, from its length, its links and the elements it
stands in; these are the capacities of its edge to the source (content) or the
sink (boilerplate).  Neighbouring blocks are tied by an edge, stronger the
closer they stand in the element tree, and each block is tied to the next one
in the same parent, whatever stands between.  The minimum cut takes the blocks
apart: a short block amid an article stays with it, a long notice amid menus
goes.

Before the flow is computed, every block whose own capacity exceeds its ties is
settled and its ties are passed on to its neighbours, which leaves the cut as it
is; on most pages little remains.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.rows import ROW, packed, unpacked, with_row

#: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math object select button xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
#: Words in class, id and role that mark page furniture, and those that mark content.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer foot header masthead topbar toolbar "
    "comment comments disqus reply replies share sharing social related recommended recommendations newsletter subscribe signup login "
    "popup modal overlay pagination pager copyright legal contentinfo complementary search skip".split()
)
CONTENT = frozenset("content article post entry story main body articlebody maincontent".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[/!?][^>]*(?:>|$)|<[a-zA-Z][^<>]*(>|$)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+")
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
          "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
SCOPES = frozenset("ul ol dl table article section div main body nav footer aside form blockquote".split())


class Element(NamedTuple):
    tag: str
    number: int
    bias: float


class Block(NamedTuple):
    """Text of a block, how much of it is in links, and the elements around it from the outside in."""

    text: str
    linked: int
    path: tuple[int, ...]
    bias: float
    heading: bool


#: Log odds of the block classifier.
DROPPED_ODDS, FURNITURE_ODDS, MAIN_ODDS, CONTENT_ODDS = -12.0, -8.0, 5.0, 2.0


def _bias(tag: str, attributes: str, inside: float) -> float:
    """Log odds that an element adds to those of the elements around it."""
    if tag in DROPPED:
        return DROPPED_ODDS
    odds = MAIN_ODDS if tag in MAIN and inside < MAIN_ODDS else FURNITURE_ODDS if tag == "header" and inside < MAIN_ODDS else 0.0
    if not attributes:
        return odds
    for name, *value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(value).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return DROPPED_ODDS
        if name in ("class", "id", "role"):
            words = set(NAME.findall(value))
            if words & FURNITURE and not (tag in ("body", "html")):
                odds += FURNITURE_ODDS
            elif words & CONTENT and tag not in ("body", "html"):
                odds += CONTENT_ODDS
    return odds


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, comments, scripts and the like are gone, references decoded."""
    found: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked, in_link, bias, number, at, skip = 0, 0, 0.0, 0, 0, None
    heading = False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, linked, tuple(e.number for e in stack if e.tag not in INLINE), bias, heading))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    for token in TOKEN.finditer(page):
        begin, end = token.span()
        if begin < at:
            continue
        if begin > at:
            add(page[at:begin])
        at = end
        tag = token[2]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), token[1], token[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                if tag not in INLINE:
                    flush()
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, end)
                at = close.end() if close else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            continue
        flush()
        in_link = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES:
                    break
        else:
            closes = CLOSES.get(tag)
            if closes or tag in SCOPES or tag[0] == "h":
                ends = closes or frozenset({"p"})
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPES:
                        break
            if not attributes.endswith("/"):
                number += 1
                around = sum(e.bias for e in stack)
                stack.append(Element(tag, number, _bias(tag, attributes, around)))
        bias = sum(e.bias for e in stack)
        heading = bool(stack) and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    if at < len(page) and not page.startswith("<", at):
        add(page[at:])
    flush()
    return found


def odds(block: Block) -> float:
    """Log odds that a block is content: its surroundings, its length, its links, its end."""
    words = block.text.count(" ") + 1
    score = -0.5 + block.bias + min(3.0, math.log2(1 + words) - 1.5)
    if block.linked:
        score -= 4.0 * min(1.0, block.linked / len(block.text))
    if block.text[-1] in ".!?:;\"'”’»…":
        score += 1.0
    if block.heading:
        score += 1.0
    return score


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours on the page, and the next block of the same parent."""
    found, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1].path
            common = 0
            for a, b in zip(before, block.path, strict=False):
                if a != b:
                    break
                common += 1
            apart = len(before) + len(block.path) - 2 * common
            found.append((i - 1, i, 2.0 / max(1, apart)))
        parent = block.path[:-1]
        if parent in last and last[parent] != i - 1:
            found.append((last[parent], i, 0.5))
        last[parent] = i
    return found


def content_side(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: which nodes stay with the source.

    ``gains``: capacity from the source if positive, to the sink if negative.
    Nodes that tie go to the sink.
    """
    n = len(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    gain, side = list(gains), [None] * n
    tied = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:  # whose own capacity exceeds its ties is settled; its ties become its neighbours' capacity
        i = queue.popleft()
        if side[i] is not None or (abs(gain[i]) <= tied[i] and near[i]) or (not near[i] and gain[i] == 0):
            continue
        side[i] = gain[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            tied[j] -= w
            gain[j] += w if side[i] else -w
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        # Augmenting paths from nodes with what the source still gives to nodes with what the sink still takes.
        flow = near  # residual capacities, changed in place
        while True:
            parent: dict[int, int] = {i: -1 for i in rest if gain[i] > 1e-12}
            search, goal = deque(parent), -1
            while search and goal < 0:
                i = search.popleft()
                for j, w in flow[i].items():
                    if w > 1e-12 and j not in parent:
                        parent[j] = i
                        if gain[j] < -1e-12:
                            goal = j
                            break
                        search.append(j)
            if goal < 0:
                break
            path, j = [], goal
            while parent[j] >= 0:
                path.append((parent[j], j))
                j = parent[j]
            amount = min(gain[j], -gain[goal], *(flow[a][b] for a, b in path))
            for a, b in path:
                flow[a][b] -= amount
                flow[b][a] = flow[b].get(a, 0.0) + amount
            gain[j] -= amount
            gain[goal] += amount
        for i in rest:
            side[i] = i in parent
    return [bool(s) for s in side]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space; empty for an empty page or one without content."""
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = content_side([odds(b) for b in blocks], ties(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without the markup column but with ``into``, the main text of each whole page.

    Null pages count as empty and have an empty text.  Repeated rows each get
    their row; a column already named as ``into`` is replaced.
    """
    names = [c for c in pages.columns if c not in (page, into)]
    rows = pages.select(packed(names), F.col(page).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [ROW, "text"])

    return unpacked(rows.mapInArrow(run, with_row(rows, "text string")), names, F.col("text").alias(into))
