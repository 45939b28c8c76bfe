"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into blocks of text. Each has its number of words and its link density (share of
words inside links), those of the blocks before and after it, what it stands in, and how much of the page's text that
holds. A tree that is trained on the small labelled table of examples() decides which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by their role in a page.
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"hr"}
_HIDDEN = set("script style noscript template title textarea select option button svg math iframe object canvas audio video head".split())
_FURNITURE = set("nav footer aside menu dialog".split())
# Words of class names, ids and roles that hint at furniture, at readers' comments, and at the article.
_HINTS = set(
    "nav navbar navigation menu sidebar footer masthead topbar toolbar ad ads advert advertisement adverts sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search breadcrumb breadcrumbs "
    "share sharing social related recommended recommendations widget pagination pager complementary "
    "copyright legal disclaimer tagcloud".split()
)
_COMMENTS = set("comment comments reply replies respond disqus discussion".split())
_ARTICLE = set("article content post entry story main".split())
# What a block stands in: nothing of note, an element whose names hint at furniture or at comments, a form, or furniture by its tag.
PLAIN, HINT, COMMENT, FORM, STRUCTURE = range(5)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKENS = re.compile(r"[a-z]+")
#: Marks that stand alone, as bars, arrows and dots between links do; they don't count in the share of linked words.
_MARKS = re.compile(r"(?<!\S)[^\w\s]++(?!\S)")
_HEADING = re.compile(r"h[1-6]\Z")
_LEGAL = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I | re.S)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    article: bool
    heading: bool
    legal: bool
    mark: int  # PLAIN to STRUCTURE
    holder: int  # number of the marked element that it stands in, 0 if there is none


class Page(NamedTuple):
    blocks: list[Block]
    outer: list[int]  # the marked element around each marked element; 0 is the page itself


def _count(text: str) -> int:
    return len(_MARKS.sub(" ", text).split())


def blocks_of(page: str) -> Page:
    """Blocks with text, in page order: references decoded, white space runs made one space, trimmed."""
    out: list[Block] = []
    outer = [0]
    stack: list[tuple[str, int, int, int]] = []  # tag, inside an article, mark, holder
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked_parts: list[str] = []
    in_link = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                linked = _count(html.unescape(" ".join(linked_parts)))
                _, article, mark, holder = stack[-1] if stack else ("", 0, PLAIN, 0)
                n, plain = text.count(" ") + 1, _count(text) or 1
                linked = n * min(plain, linked) // plain
                out.append(Block(text, n, linked, article > 0, any(_HEADING.match(t[0]) for t in stack[-2:]), _LEGAL.match(text) is not None, mark, holder))
        parts.clear()
        linked_parts.clear()

    def words(raw: str) -> None:
        if raw:
            parts.append(raw)
            if in_link:
                linked_parts.append(raw)

    at = 0
    while True:
        found = _TAG.search(page, at)
        if found is None:
            words(page[at:])
            break
        words(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, rest = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in _HIDDEN:
            if not closing and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>|(?=<body\b)" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            if closing:
                in_link = 0
                while opened[tag]:  # up to the innermost of this tag
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
            elif tag not in _VOID:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                    opened["p"] -= 1
                _, article, mark, holder = stack[-1] if stack else ("", 0, PLAIN, 0)
                named = {t for m in _NAMED.finditer(rest) for t in _TOKENS.findall((m[1] or m[2] or m[3] or "").lower())} if rest and tag not in ("html", "body") else set()
                own = STRUCTURE if tag in _FURNITURE or (tag == "header" and not article) else COMMENT if named & _COMMENTS else HINT if named & _HINTS else FORM if tag == "form" else PLAIN
                if own and mark != STRUCTURE:
                    outer.append(holder)
                    mark, holder = own, len(outer) - 1
                if tag in ("article", "main") or named & _ARTICLE:
                    article += 1
                stack.append((tag, article, mark, holder))
                opened[tag] += 1
    flush()
    return Page(out, outer)


def features(page: Page) -> list[tuple[float, ...]]:
    """The values of COLUMNS for each block."""
    blocks = page.blocks
    density = [b.linked / b.words for b in blocks]
    words = [b.words for b in blocks]
    held = [0] * len(page.outer)
    plain = 0
    for b, d in zip(blocks, density, strict=True):
        if d < 0.5 and not b.heading and b.mark != STRUCTURE and (b.article or not b.legal):
            held[b.holder] += b.words
            plain += b.words if b.mark == PLAIN else 0
    for h in range(len(held) - 1, 0, -1):
        held[page.outer[h]] += held[h]
    around = lambda x, i: x[i] if 0 <= i < len(x) else 0
    return [
        (words[i], density[i], around(words, i - 1), around(density, i - 1), around(words, i + 1), around(density, i + 1), b.article, b.heading, b.legal, b.mark, held[b.holder] / max(1, held[0]) if b.mark else 0.0, held[b.holder] if b.mark else 0, plain)
        for i, b in enumerate(blocks)
    ]


#: Names of the tree's features. share: of the page's text (words outside menus and footers, links and headings), that of
#: the marked element; held: its words of it; plain: words of that text outside marked elements.
COLUMNS = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "article", "heading", "legal", "mark", "share", "held", "plain")


def examples(pages: int = 400, seed: int = 9) -> list[tuple[Page, list[bool]]]:
    """The labelled table: blocks of typical pages with lengths drawn at random, and which of them are the article."""
    rng = np.random.default_rng(seed)
    out = []

    def upto(a: int, b: int) -> int:
        return int(round(a * (b / a) ** rng.random()))  # as many short ones as long ones

    def block(words: int, linked: float = 0.0, article: bool = False, heading: bool = False, legal: bool = False, mark: int = PLAIN, holder: int = 0) -> Block:
        return Block("", words, round(words * linked), article, heading, legal, mark, holder)

    for k in range(pages):
        rows: list[tuple[Block, bool]] = []
        outer = [0]

        def marked() -> int:
            outer.append(0)
            return len(outer) - 1

        def menu(mark: int, least: int = 2) -> None:
            h = marked() if mark else 0
            for i in range(upto(least, 7)):
                rows.append((block(upto(1, 5), 1.0, mark=mark, holder=h), False))
                if i and rng.random() < 0.2:  # a title between the links
                    rows.append((block(upto(1, 3), 0.0, mark=mark, holder=h), False))
                    rows.append((block(upto(1, 5), 1.0, mark=mark, holder=h), False))

        def article(mark: int, inside: bool, paragraphs: int, longest: int = 250, least: int = 1) -> None:
            h = marked() if mark else 0
            if rng.random() < 0.6:
                rows.append((block(upto(1, 12), float(rng.random() < 0.2), inside, True, mark=mark, holder=h), True))
            for i in range(paragraphs):
                n = upto(least, longest)
                rights = rng.random() < 0.1 and (inside or n > 30)  # it speaks of rights
                rows.append((block(n, 0.35 * rng.random() if rng.random() < 0.3 else 0.0, inside, False, rights, mark, h), True))
                if (inside or n >= 10) and rng.random() < 0.08:  # a line that is a link
                    rows.append((block(upto(1, 8), 1.0, inside, mark=mark, holder=h), True))
                    rows.append((block(upto(20, 120), 0.0, inside, mark=mark, holder=h), True))
                if rng.random() < 0.1 and i + 1 < paragraphs:
                    rows.append((block(upto(1, 8), 0.0, inside, True, mark=mark, holder=h), True))

        def beside(mark: int, blocks: int, longest: int, linked: float = 0.0) -> None:
            h = marked()
            for _ in range(blocks):
                rows.append((block(upto(2, longest), linked if rng.random() < 0.5 else 0.0, rng.random() < 0.1, rng.random() < 0.1, mark=mark, holder=h), False))

        shape = k % 10
        if shape == 0:  # an article with its tag between a menu, an advert and a footer
            menu(STRUCTURE)
            beside(HINT, 1 if k % 20 else upto(1, 4), 30 if k % 20 else 150)
            article(PLAIN, True, upto(1, 8) if k % 20 else 1, 250 if k % 20 else 3)
            if rng.random() < 0.5:
                beside(STRUCTURE, 1, 40)
            beside(STRUCTURE, 1, 20, 0.3)
        elif shape == 1:  # nothing marked: a menu, an article, a list of links, a line of rights
            menu(PLAIN, 3)
            article(PLAIN, False, upto(2, 8), least=4)
            if rng.random() < 0.6:
                menu(PLAIN, 3)
            if rng.random() < 0.6:
                rows.append((block(upto(3, 18), 0.3 * rng.random(), legal=True), False))
        elif shape == 2:  # nothing but an article, or one below a link
            if rng.random() < 0.5:
                rows.append((block(upto(1, 4), 1.0), False))
            article(PLAIN, False, upto(1, 5))
        elif shape == 3:  # a marked menu before an article without marks or footer
            menu(STRUCTURE if rng.random() < 0.5 else HINT)
            article(PLAIN, False, upto(1, 5))
        elif shape == 4:  # the article's own element has a name that hints at furniture
            if rng.random() < 0.7:
                menu(STRUCTURE)
            for _ in range(upto(1, 3) if k % 20 == 4 else 0):
                beside(HINT, 1, 15)
            if k % 20 == 14:  # and a longer notice
                beside(HINT, 1, 50)
                beside(HINT, 1, 50)
            article(HINT if rng.random() < 0.7 else COMMENT, rng.random() < 0.6, upto(2, 8), *((60, 12) if k % 20 == 4 else (250, 60)))
            rows.append((block(upto(1, 20), mark=rows[-1][0].mark, holder=len(outer) - 1), True))  # its last line is short
            if rng.random() < 0.5:
                beside(STRUCTURE, 1, 12)
        elif shape == 5:  # readers' comments, often longer than the article
            menu(STRUCTURE)
            article(PLAIN, rng.random() < 0.7, upto(1, 4), 120 if k % 20 == 5 else 6)
            beside(COMMENT, upto(2, 10), 250)
            beside(STRUCTURE, 1, 12)
        elif shape == 6:  # sidebars and notices of long texts
            beside(HINT, upto(1, 4), 90)
            menu(HINT)
            article(PLAIN, rng.random() < 0.7, upto(1, 5), 250 if k % 20 == 6 else 8)
            beside(HINT, upto(1, 4), 120, 0.4)
            if rng.random() < 0.5:
                rows.append((block(upto(3, 18), 0.0, legal=True), False))
        elif shape == 7:  # a form in the article, or one around the whole page
            if rng.random() < 0.5:
                article(PLAIN, True, upto(2, 5), least=8)
                beside(FORM, upto(1, 4), 12)
                article(PLAIN, True, upto(1, 3), least=4)
            else:
                article(FORM, rng.random() < 0.5, upto(2, 6), least=15)
                rows.append((block(upto(1, 20), mark=FORM, holder=len(outer) - 1), True))
        elif shape == 8:  # no article: menus, a form to log in, a footer
            menu(STRUCTURE)
            if rng.random() < 0.5:
                beside(FORM, upto(1, 4), 6)
            if rng.random() < 0.5:
                beside(HINT, 1, 12)
            beside(STRUCTURE, upto(1, 3), 40)
        else:  # links after the article, inside its element
            menu(STRUCTURE)
            article(PLAIN, True, upto(1, 5), least=15)
            for _ in range(upto(3, 6)):
                rows.append((block(upto(2, 8), 1.0, True), False))
            beside(STRUCTURE, 1, 20)
        out.append((Page([b for b, _ in rows], outer), [y for _, y in rows]))
    return out


class Tree(NamedTuple):
    """Feature and threshold of each inner node (value < threshold goes left), children, and each leaf's answer."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    answer: list[bool]


def train(pages: list[tuple[Page, list[bool]]] | None = None, depth: int = 8, least: int = 3) -> Tree:
    """Least Gini impurity at each cut, `least` rows on either side; ties to the first feature and the lowest cut."""
    table = labelled(examples() if pages is None else pages)
    tree = Tree([], [], [], [], [])

    def gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return len(y) * p * (1 - p)

    def grow(rows: np.ndarray, level: int) -> int:
        node = len(tree.feature)
        y = rows[:, -1]
        for column, value in zip(tree, (-1, 0.0, -1, -1, bool(y.mean() >= 0.5)), strict=True):
            column.append(value)
        if level == depth or y.min() == y.max():
            return node
        options = []
        for f in range(rows.shape[1] - 1):
            for a, b in zip(v := np.unique(rows[:, f]), v[1:], strict=False):
                low = rows[:, f] < (a + b) / 2
                if min(low.sum(), (~low).sum()) >= least:
                    options.append((round(gini(y[low]) + gini(y[~low]), 9), f, (a + b) / 2))
        if options and min(options)[0] < gini(y) - 1e-9:
            _, f, c = min(options)
            tree.feature[node], tree.cut[node] = f, c
            tree.left[node] = grow(rows[rows[:, f] < c], level + 1)
            tree.right[node] = grow(rows[rows[:, f] >= c], level + 1)
        return node

    grow(table, 0)
    return tree


def labelled(pages: list[tuple[Page, list[bool]]]) -> np.ndarray:
    """Rows of features and labels; features that depend on other blocks are those within the page."""
    return np.array([[*f, y] for page, labels in pages for f, y in zip(features(page), labels, strict=True)], float)


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks, joined by line feeds."""
    found = blocks_of(page or "")
    kept = []
    for block, values in zip(found.blocks, features(found), strict=True):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if values[tree.feature[node]] < tree.cut[node] else tree.right[node]
        if tree.answer[node]:
            kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", table: list[tuple[Page, list[bool]]] | None = None) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without an article, have an empty text. Broken markup is read as far as it goes:
    unclosed tags end with what holds them, an unclosed comment, script or tag takes the rest of the page; nesting may be of
    any depth. Null ids and urls stay null; repeated rows give equal rows; an empty table gives none. Other columns, whatever
    their names, are ignored. table: labelled pages to train on, examples() by default."""
    tree = train(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                texts = [main_text(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(read, "page_id long, url string, text string, n_chars long")
