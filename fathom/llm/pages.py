"""Main text of HTML pages: flat text blocks, classified by a decision tree on themselves and their neighbours.

A page is cut into blocks at block-level tags. A block knows its words, its link density, those of the
blocks before and behind it, whether it is a heading or a list item, and whether the elements around it
are marked as an article or as something beside one (by tag, role, class or id). A small table of labelled
blocks trains the tree; the blocks it calls content, in page order, are the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import add_columns, column_of

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg math object canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote body details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " main menu nav ol p pre section table ul".split()
)
BESIDE_TAGS = frozenset("nav footer aside form menu dialog button select option label legend fieldset head".split())
ARTICLE_TAGS = frozenset(("article", "main"))
BESIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard sponsor sponsored promo promotion"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs sitemap"
    " header masthead topbar footer colophon copyright legal disclaimer sidebar aside rail widget widgets"
    " cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription"
    " signup login form search searchbox comment comments commentlist disqus reply replies respond discussion"
    " share sharing social follow related recommended recommendations trending popular tags taglist hidden".split()
)
#: Names that hold even for an element with most of the page's words.
FINAL_NAMES = frozenset("comment comments commentlist disqus replies respond discussion hidden cookie cookies consent gdpr modal popup".split())
ARTICLE_NAMES = frozenset("article content post story entry main body text articlebody postcontent".split())
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)

FEATURES = (
    "words", "link_share", "words_before", "link_share_before", "words_behind", "link_share_behind", "beside", "article", "heading", "item",
)
#: Labelled blocks in the order of FEATURES, with 1 behind them for content and 0 for the rest.
LABELLED = (
    # Menus, their neighbours being menus or the first lines of a text.
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0), (1, 1.0, 2, 1.0, 9, 0.0, 1, 0, 0, 1, 0),
    (3, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1, 0), (1, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (12, 1.0, 0, 0.0, 14, 0.0, 0, 0, 0, 0, 0),
    (8, 0.9, 5, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (4, 1.0, 55, 0.0, 4, 1.0, 0, 1, 0, 1, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 1, 0, 1, 0),
    (7, 1.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (20, 0.95, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 30, 0.1, 2, 1.0, 0, 0, 0, 0, 0),
    # Headers, footers, notices, adverts, forms, sidebars and comments that are marked as such.
    (6, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0, 0), (15, 0.0, 1, 1.0, 11, 0.0, 1, 0, 0, 0, 0), (40, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (120, 0.0, 60, 0.0, 30, 0.0, 1, 0, 0, 0, 0), (25, 0.2, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (4, 0.0, 45, 0.0, 70, 0.0, 1, 0, 1, 0, 0),
    (3, 0.0, 2, 0.0, 5, 0.0, 1, 0, 0, 0, 0), (18, 0.0, 70, 0.0, 65, 0.0, 1, 1, 0, 0, 0), (60, 0.0, 80, 0.0, 20, 0.0, 1, 1, 0, 0, 0),
    (2, 0.0, 60, 0.0, 50, 0.0, 1, 1, 1, 0, 0), (9, 0.5, 50, 0.0, 0, 0.0, 1, 1, 0, 0, 0), (300, 0.0, 4, 0.0, 80, 0.0, 1, 0, 0, 0, 0),
    (10, 0.0, 0, 0.0, 9, 0.0, 1, 0, 1, 0, 0), (200, 0.0, 300, 0.0, 150, 0.0, 1, 1, 0, 0, 0), (30, 0.0, 5, 0.0, 9, 0.0, 1, 0, 0, 1, 0),
    # Short unmarked blocks with menus or little text around them.
    (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (6, 0.0, 3, 0.0, 5, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 1, 0, 0),
    (3, 0.0, 4, 1.0, 2, 1.0, 0, 0, 1, 0, 0), (5, 0.0, 60, 0.0, 12, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 9, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (6, 0.0, 9, 1.0, 11, 1.0, 0, 0, 0, 0, 0), (7, 0.3, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1, 0),
    (8, 0.0, 5, 0.0, 7, 0.0, 0, 0, 0, 0, 0), (9, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0, 0, 0), (4, 0.0, 7, 0.0, 8, 0.0, 0, 0, 0, 1, 0),
    (1, 0.0, 8, 0.0, 9, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 1, 1.0, 5, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 6, 0.0, 4, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 40, 0.0, 3, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 9, 0.0, 9, 0.0, 0, 0, 0, 1, 0), (6, 0.0, 8, 0.5, 7, 0.0, 0, 0, 0, 0, 0),
    (9, 0.0, 6, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 7, 0.0, 0, 0, 1, 0, 0), (8, 0.2, 4, 0.0, 5, 0.2, 0, 0, 0, 0, 0),
    # Text inside an article, of any length, with any neighbours.
    (1, 0.0, 0, 0.0, 1, 0.0, 0, 1, 0, 0, 1), (2, 0.0, 1, 1.0, 30, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 12, 0.0, 30, 0.0, 0, 1, 0, 0, 1),
    (9, 0.0, 11, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (12, 0.0, 1, 1.0, 40, 0.0, 0, 1, 1, 0, 1), (3, 0.0, 60, 0.0, 50, 0.0, 0, 1, 1, 0, 1),
    (80, 0.0, 12, 0.0, 70, 0.0, 0, 1, 0, 0, 1), (60, 0.1, 80, 0.0, 4, 0.0, 0, 1, 0, 0, 1), (35, 0.3, 40, 0.0, 50, 0.0, 0, 1, 0, 0, 1),
    (25, 0.45, 40, 0.0, 50, 0.0, 0, 1, 0, 0, 1), (500, 0.0, 5, 0.0, 20, 0.0, 0, 1, 0, 0, 1), (5, 0.0, 60, 0.0, 6, 0.0, 0, 1, 0, 1, 1),
    (6, 0.3, 5, 0.0, 8, 0.0, 0, 1, 0, 1, 1), (4, 0.0, 90, 0.0, 10, 0.5, 0, 1, 0, 0, 1), (2, 0.0, 3, 0.0, 4, 0.0, 0, 1, 0, 1, 1),
    (8, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 1), (14, 0.2, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 1), (3, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 1),
    (5, 0.0, 60, 0.0, 12, 1.0, 0, 1, 0, 0, 1), (3, 0.0, 10, 1.0, 20, 1.0, 0, 1, 0, 0, 1), (1, 0.0, 90, 0.0, 5, 1.0, 0, 1, 0, 0, 1),
    (4, 0.0, 5, 0.0, 7, 0.0, 0, 1, 0, 0, 1), (6, 0.0, 8, 0.0, 9, 0.0, 0, 1, 0, 0, 1), (9, 0.0, 7, 0.0, 5, 0.0, 0, 1, 0, 0, 1),
    (2, 0.0, 9, 0.0, 8, 0.0, 0, 1, 0, 0, 1), (7, 0.0, 6, 0.0, 3, 0.0, 0, 1, 0, 0, 1), (3, 0.0, 4, 0.0, 6, 0.0, 0, 1, 1, 0, 1),
    (8, 0.0, 2, 0.0, 9, 0.0, 0, 1, 0, 0, 1), (5, 0.0, 1, 0.0, 5, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 6, 0.0, 2, 0.0, 0, 1, 0, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (6, 0.0, 4, 1.0, 9, 1.0, 0, 1, 1, 0, 1), (11, 0.6, 30, 0.0, 4, 0.0, 0, 1, 0, 0, 1),
    # Long unmarked blocks, and short ones between them.
    (45, 0.0, 2, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (60, 0.05, 45, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 3, 1.0, 45, 0.0, 0, 0, 0, 0, 1),
    (22, 0.1, 50, 0.0, 4, 1.0, 0, 0, 0, 0, 1), (15, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (90, 0.2, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 1),
    (4, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0, 1), (7, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (8, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1, 1), (18, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 1), (13, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (16, 0.3, 70, 0.1, 60, 0.1, 0, 0, 0, 0, 1), (10, 0.0, 0, 0.0, 35, 0.0, 0, 0, 1, 0, 1),
)


@dataclass
class Node:
    """A question (feature below limit goes to ``low``) or, without children, an answer."""

    content: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def classify(self, row) -> bool:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] < node.limit else node.high
        return node.content


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A tree that splits by the greatest fall of the Gini impurity; the earlier feature wins a tie."""
    here = Node(bool(2 * labels.sum() >= len(labels)))
    if depth == 0 or labels.min() == labels.max():
        return here
    best = (1e-12, -1, 0.0)
    total, positive = len(labels), labels.sum()
    base = 2 * positive * (total - positive) / total
    for feature in range(rows.shape[1]):
        order = np.argsort(rows[:, feature], kind="stable")
        values, sums = rows[order, feature], np.cumsum(labels[order])
        for k in np.flatnonzero(values[1:] > values[:-1]) + 1:
            if k < least or total - k < least:
                continue
            left = sums[k - 1]
            right = positive - left
            gain = base - 2 * left * (k - left) / k - 2 * right * (total - k - right) / (total - k)
            if gain > best[0] + 1e-9:
                best = (gain, feature, (values[k - 1] + values[k]) / 2)
    if best[1] < 0:
        return here
    low = rows[:, best[1]] < best[2]
    return Node(here.content, best[1], best[2], grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least))


def trained_tree(labelled=LABELLED) -> Node:
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1])


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    beside: bool
    article: bool
    heading: bool
    item: bool


def _marks(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is beside an article for good, whether as an article, whether beside by name only, whether <article> or main."""
    named, roles = False, set()
    beside = tag in BESIDE_TAGS or tag == "header" and not inside_article
    article = tag in ARTICLE_TAGS
    if attributes and tag not in ("html", "body"):
        for name, value in _NAMES.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                beside = True
            elif name == "style":
                beside |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif name in ("class", "id", "role"):
                parts = {p.lower() for p in _WORD_PARTS.findall(value)}
                if name == "role":
                    roles.add(value.lower())
                    article |= value.lower() == "main"
                if not article:
                    beside |= not parts.isdisjoint(FINAL_NAMES)
                    named |= not parts.isdisjoint(BESIDE_NAMES)
                article |= not parts.isdisjoint(ARTICLE_NAMES)
    return beside, article and not beside, named and not beside, tag in ARTICLE_TAGS or "main" in roles


def text_blocks(html: str) -> list[Block]:
    """The page's blocks in order. Unclosed and wrongly nested elements end with the element around them."""
    blocks: list[Block] = []
    # Tag, beside, article, innermost element around that only a name marks as beside, innermost <article> or main; 0 is none.
    stack: list[tuple[str, bool, bool, int, int]] = []
    around: list[tuple[int, int]] = []
    named: dict[int, tuple[int, bool]] = {}
    main: dict[int, tuple[int, int]] = {}
    parts: list[str] = []
    link_parts: list[str] = []
    links, at, size = 0, 0, len(html)

    def flush() -> None:
        words = "".join(parts).split()
        if words:
            text = " ".join(words)
            _, beside, article, name, holder = stack[-1] if stack else ("", False, False, 0, 0)
            tags = {t for t, *_ in stack[-4:]}
            around.append((name, holder))
            beside = beside or not article and len(words) < 40 and _RIGHTS.match(text) is not None
            linked = min(len(words), len("".join(link_parts).split()))
            blocks.append(Block(text, len(words), linked, beside, article, not tags.isdisjoint(HEADINGS), "li" in tags))
        parts.clear()
        link_parts.clear()

    def add(text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                link_parts.append(text)
                link_parts.append(" ")

    while at < size:
        found = _TAG.search(html, at)
        if not found:
            add(html[at:])
            break
        add(html[at : found.start()])
        at = found.end()
        if found[0].startswith("<![CDATA["):
            parts.append(found[0][9:].removesuffix("]]>"))
            continue
        close, tag, attributes = (found[k] if found[2] else found[k + 3] for k in (1, 2, 3))
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if close else 1
            if not close and attributes and "hidden" in attributes and _marks(tag, attributes, False)[0]:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else at
                links = 0 if tag == "a" else links
            continue
        flush()
        if tag in RAW:
            if not close and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else (size if tag in ("script", "style", "title", "textarea") else at)
            continue
        links = 0
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag == "body":
                stack = [s for s in stack if s[0] == "html"]
            if tag in CLOSES_PARAGRAPH and stack and stack[-1][0] == "p":
                stack.pop()
            if stack and stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                stack.pop()
            _, beside, article, name, holder = stack[-1] if stack else ("", False, False, 0, 0)
            mine = _marks(tag, attributes, article)
            if mine[3] and not mine[0]:
                main[at] = holder, name
                holder = at
            if mine[2]:
                named[at] = name, mine[1]
                name = at
            stack.append((tag, beside or mine[0], article or mine[1] and not mine[2], name, holder))
    flush()
    if named:
        _settle_names(blocks, around, named, main)
    return blocks


def _settle_names(blocks: list[Block], around: list, named: dict[int, tuple[int, bool]], main: dict[int, tuple[int, int]]) -> None:
    """Marks by name hold but for elements with most of the page's unlinked words or with its longest article."""
    inside, articles, total = dict.fromkeys(named, 0), dict.fromkeys(main, 0), 0
    for b, (name, holder) in zip(blocks, around):
        if not b.beside:
            plain = b.words - b.link_words
            total += plain
            if name:
                inside[name] += plain
            if holder:
                articles[holder] += plain
    # Inner elements stand behind outer ones: one pass from the end adds them up.
    for words, outer in ((inside, named), (articles, main)):
        for k in reversed(outer):
            if outer[k][0]:
                words[outer[k][0]] += words[k]
    void = {k for k, n in inside.items() if 2 * n > total}
    if articles:
        k = main[max(articles, key=articles.get)][1]
        while k:
            void.add(k)
            k = named[k][0]
    state = {0: (False, False)}
    for k, (outer, article) in named.items():
        state[k] = state[outer][0] or k not in void, state[outer][1] or article and k in void
    for b, (name, _) in zip(blocks, around):
        b.beside, b.article = b.beside or state[name][0], b.article or state[name][1]


def main_text(html: str, tree: Node) -> str:
    """The blocks that the tree calls content, joined by spaces."""
    blocks = text_blocks(html)
    sizes = [(0, 0.0), *((b.words, b.link_words / b.words) for b in blocks), (0, 0.0)]
    kept = []
    for k, b in enumerate(blocks):
        if tree.classify((*sizes[k + 1], *sizes[k], *sizes[k + 2], b.beside, b.article, b.heading, b.item)):
            kept.append(b.text)
    return " ".join(kept)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text", labelled=LABELLED, without: tuple[str, ...] = ()):
    """``pages`` with the main text of the whole page in ``name``; null and empty pages have empty text.

    White space inside a block becomes one space, character references are decoded, and nothing is cut
    or dropped but what the tree, trained on ``labelled``, rejects. A column called ``name`` is replaced;
    the others stay, except those in ``without``. An empty table gives an empty table.
    """
    tree = trained_tree(labelled)

    def make(batch: pa.RecordBatch) -> list:
        return [pa.array([main_text(p, tree) if p else "" for p in column_of(batch, html).to_pylist()], pa.string())]

    return add_columns(pages, f"{name} string", make, without)
