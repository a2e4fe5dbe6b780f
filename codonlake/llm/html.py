"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block has
a word count and a link density, its neighbours have theirs, and a zone tells
whether the innermost container that says so is an article or something around
it. A decision tree grown on the labelled table below decides which blocks are
main text. Each page is handled alone in its task; there is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Labelled blocks: words and link density of the block before, of the block and of the block after it;
#: zone (1 article, 0 none, -1 surroundings); whether it is main text.
#: Where a page marks its article, blocks of all sizes are main text in it and none around it.
_MARKED = [
    (before, link, words, density, after, link_after, zone, int(zone > 0))
    for zone in (1, -1)
    for words, density in ((1, 0.0), (2, 1.0), (9, 0.0), (14, 0.5), (30, 0.0), (44, 0.2), (120, 0.0), (400, 0.0))
    for before, link in ((0, 0.0), (1, 1.0), (60, 0.0), (200, 0.0))
    for after, link_after in ((0, 0.0), (1, 1.0), (60, 0.0), (200, 0.0))
]
#: Elsewhere long blocks with few links are, link lists are not, and short blocks are between long ones.
_NEXT_TO = ((0, 0.0), (2, 1.0), (60, 0.0))
_CLEAR = [
    (*before, words, density, *after, 0, label)
    for before in _NEXT_TO
    for after in _NEXT_TO
    for words, density, label in (
        *((n, d, 1) for n in (30, 60, 120) for d in (0.0, 0.2)),
        *((n, d, 0) for n in (2, 12, 40) for d in (0.7, 1.0)),
        *((n, 0.0, int(before == after == (60, 0.0))) for n in (3, 7)),
    )
]
LABELLED = _MARKED + _CLEAR + [
    # pages without such marks: long text with few links, or short text between long ones
    (0, 0.0, 45, 0.0, 50, 0.0, 0, 1), (40, 0.0, 60, 0.05, 38, 0.0, 0, 1), (55, 0.0, 18, 0.0, 64, 0.0, 0, 1),
    (60, 0.0, 6, 0.0, 72, 0.0, 0, 1), (35, 0.1, 90, 0.1, 4, 1.0, 0, 1), (2, 1.0, 33, 0.0, 41, 0.0, 0, 1),
    (20, 0.0, 22, 0.0, 19, 0.0, 0, 1), (80, 0.0, 25, 0.2, 6, 0.5, 0, 1), (3, 0.0, 28, 0.0, 30, 0.0, 0, 1),
    (48, 0.0, 11, 0.0, 33, 0.0, 0, 1), (30, 0.0, 19, 0.0, 2, 0.0, 0, 1), (66, 0.0, 40, 0.3, 50, 0.0, 0, 1),
    (0, 0.0, 2, 1.0, 2, 1.0, 0, 0), (2, 1.0, 3, 1.0, 1, 1.0, 0, 0), (1, 1.0, 4, 0.0, 2, 1.0, 0, 0),
    (3, 0.5, 12, 0.9, 4, 0.5, 0, 0), (60, 0.0, 8, 0.8, 2, 1.0, 0, 0), (50, 0.0, 30, 0.7, 20, 0.6, 0, 0),
    (2, 1.0, 5, 0.0, 3, 0.0, 0, 0), (4, 0.0, 6, 0.0, 0, 0.0, 0, 0), (1, 1.0, 10, 0.4, 1, 1.0, 0, 0),
    (0, 0.0, 3, 0.0, 2, 1.0, 0, 0), (5, 0.6, 7, 0.0, 1, 1.0, 0, 0), (9, 0.9, 22, 0.6, 5, 1.0, 0, 0),
]
_RAW = "script|style|textarea|noscript|template|iframe|object|svg|math|select|button|title|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?:svg|math)\b(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|</?[a-z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_ARTICLE = {"article", "main"}
_AROUND = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "head"}
_CONTAINERS = _ARTICLE | _AROUND | {"div", "section", "ul", "ol", "dl", "table", "p", "li", "blockquote", "figure", "details"}
_HREF = re.compile(r"\bhref\s*=", re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_AROUND_WORD = (
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|banners?|nav|navbar|navigation|menus?"
    r"|breadcrumbs?|sidebars?|footers?|headers?|masthead|cookies?|notices?|consent|popups?|newsletters?|subscribe"
    r"|comments?|replies|respond|related|share|sharing|social|widgets?|toolbar|pagination|pager|alert|complementary"
    r"|contentinfo)"
)
#: Parts that leave a compound name what its other part says: ``site-footer`` and ``comment-list``, but not ``entry-header``.
_PLACE = (
    r"(?:site|main|global|top|bottom|left|right|primary|secondary|wrapper|container|list|box|block|area|inner|bar|links?"
    r"|buttons?|posts|form)"
)
_AROUND_NAMES = re.compile(
    rf"(?:{_PLACE}[_-])*{_AROUND_WORD}(?:[_-](?:{_AROUND_WORD}|{_PLACE}))*(?:[_-]?\d+)?", re.IGNORECASE
)
_ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-]body$|[\s_-]content$)", re.IGNORECASE)


def _zone_of(tag: str, rest: str, inside: int) -> int | None:
    """What a container says about its content; None if nothing. An article's tag wins over names, which count whole."""
    if tag in _ARTICLE:
        return 1
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).split() if rest else []
    if any(_AROUND_NAMES.fullmatch(name) for name in names):
        return -1
    if inside >= 0 and any(_ARTICLE_NAMES.search(name) for name in names):
        return 1
    if tag in _AROUND:
        return 1 if tag == "header" and inside > 0 else -1
    return None


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """``(text, words, words in links, zone)`` of each text block of a page, in order; blocks without text are left out."""
    out: list[tuple[str, int, int, int]] = []
    texts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    links = zone = at = 0
    around = 0  # containers that were open when the link began; it ends with them at the latest

    def close() -> None:
        text = " ".join("".join(texts).split())
        if text:
            out.append((text, text.count(" ") + 1, len("".join(linked).split()), zone))
        texts.clear()
        linked.clear()

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if links:
            linked.append(text + " ")

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            links = 0 if token["end"] or not _HREF.search(token["rest"]) else 1
            around = len(stack)
        elif tag not in _INLINE:
            close()
            if tag in _CONTAINERS:
                if token["end"]:
                    depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                    if depth is not None:
                        del stack[depth:]
                        links = links if depth >= around else 0
                elif tag not in _VOID and not (tag == "p" and stack and stack[-1][0] == "p"):
                    said = _zone_of(tag, token["rest"], zone)
                    stack.append((tag, zone if said is None else said))
                elif tag == "p":
                    said = _zone_of(tag, token["rest"], zone)
                    outer = stack[-2][1] if len(stack) > 1 else 0
                    stack[-1] = ("p", outer if said is None else said)
                    links = links if len(stack) > around else 0
                zone = stack[-1][1] if stack else 0
    if at < len(page):
        add(page[at:])
    close()
    return out


def grown(rows: list[tuple], depth: int = 6) -> tuple | bool:
    """A decision tree: ``(feature, limit, tree up to the limit, tree above it)`` or a verdict, by Gini impurity."""
    yes = sum(r[-1] for r in rows)
    if depth == 0 or yes in (0, len(rows)):
        return 2 * yes >= len(rows)
    best = None
    for k in range(len(rows[0]) - 1):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            left = [r[-1] for r in rows if r[k] <= limit]
            right = [r[-1] for r in rows if r[k] > limit]
            impurity = sum(len(s) * (p := sum(s) / len(s)) * (1 - p) for s in (left, right))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, limit)
    if best is None:
        return 2 * yes >= len(rows)
    _, k, limit = best
    return k, limit, grown([r for r in rows if r[k] <= limit], depth - 1), grown([r for r in rows if r[k] > limit], depth - 1)


@cache
def default_tree() -> tuple | bool:
    return grown(LABELLED)


def _says(tree: tuple | bool, features: tuple) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree: tuple | bool | None = None) -> str:
    """Main text of one page: its blocks joined by single spaces; empty if there are none or the page is null."""
    if not page:
        return ""
    tree = default_tree() if tree is None else tree
    found = blocks(page)
    sizes = [(0, 0.0), *((n, linked / n) for _, n, linked, _ in found), (0, 0.0)]
    return " ".join(
        block[0]
        for k, block in enumerate(found)
        if _says(tree, (*sizes[k], *sizes[k + 1], *sizes[k + 2], block[3]))
    )


def extracted(df: DataFrame, column: str = "html", text: str = "text", tree: tuple | bool | None = None) -> DataFrame:
    """Add ``text``, the main text of every page. Any other columns stay; a null page has an empty text."""

    @F.pandas_udf(T.StringType())
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return df.withColumn(text, texts(F.col(column)))


def page_texts(df: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    return extracted(df.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
