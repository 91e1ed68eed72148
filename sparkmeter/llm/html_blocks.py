"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once into flat blocks: the text between block tags, with its word count, the share
of its words in links, and what encloses it. The features of a block are its own numbers, those of
the blocks before and after it, and its enclosure. A decision tree trained on a few labelled pages
(below) tells article text from the rest. Pages are independent rows, so the work is one map.

The blocks of a page keep their order. Character references are decoded, white space inside a
block becomes one space (a line break too), inline tags vanish. A null or empty page, and one
without article text, gives an empty text. Cut-off pages are read as far as they go: an open tag
or script at the end is dropped. Repeated rows are independent; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import chunks

#: Elements whose content is never text of the page.
RAW = "script style textarea title noscript template svg select button iframe object".split()
#: Elements that may enclose blocks; they end blocks, and tell what the blocks belong to.
CONTAINERS = (
    "div section article main nav header footer aside form ul ol dl table tr td th blockquote"
    " figure details dialog head body center fieldset menu"
).split()
#: Other elements that end a block.
BREAKS = "p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption thead tbody tfoot summary html".split()
_BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
_BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w+|promo\w*|sponsor\w*|banner|cookies?|consent|notices?|alert|"
    r"side-?bar|menu|nav\w*|breadcrumbs?|foot(?:er)?|comments?|replies|respond|disqus|related|"
    r"share|sharing|social|newsletter|subscribe|signup|login|search|popup|modal|widget|masthead|"
    r"pagination|pager|tags?|byline)(?:$|[\s_-])"
)
_ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|alert|dialog|form")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^\"'<>]|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?=[/a-z])[^<>]*+\Z"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

FEATURES = (
    "words link_density words_before density_before words_after density_after"
    " in_boilerplate in_article heading"
).split()


@dataclass(frozen=True)
class Block:
    text: str
    words: int
    linked: int
    boilerplate: bool
    article: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _marks(tag: str, rest: str, inside_article: bool) -> bool:
    """Whether an element holds boilerplate by its name, class, id or role."""
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not inside_article):
        return True
    for name, *values in _ATTRIBUTE.findall(rest) if "=" in rest else ():
        value = "".join(values).lower()
        if (_ROLES if name.lower() == "role" else _BOILERPLATE_NAMES).search(value):
            return True
    return False


def blocks_of(page: str | None) -> list[Block]:
    """Flat text blocks of a page, in order."""
    out: list[Block] = []
    pieces: list[str] = []
    # Open containers: (name, boilerplate around here, article around here).
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    linked, in_link, heading = 0, False, False

    def close() -> None:
        nonlocal linked
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                text = " ".join(words)
                out.append(Block(text, len(words), min(linked, len(words)), stack[-1][1], stack[-1][2], heading))
            pieces.clear()
        linked = 0

    for found in _TOKEN.finditer(page or ""):
        kind = found.lastgroup
        text = found["text"]
        if text is not None:
            pieces.append(text)
            if in_link:
                linked += len(text.split())
            continue
        tag = found["tag"]
        if tag is None:
            if kind == "raw" and found["raw"].lower() in ("textarea", "select", "button"):
                pieces.append(" ")
            continue
        tag, end = tag.lower(), bool(found["end"])
        if tag == "a":
            in_link = not end
        elif tag == "br":
            pieces.append(" ")
        elif tag in _CONTAINER_SET:
            close()
            in_link = heading = False
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if tag == "body":
                    stack[:] = [e for e in stack if e[0] != "head"]
                _, bad, good = stack[-1]
                bad = bad or _marks(tag, found["rest"], good)
                stack.append((tag, bad, good or tag in ("article", "main")))
        elif tag in _BREAK_SET:
            close()
            in_link = False
            heading = tag[0] == "h" and tag[1:].isdigit() and not end
    close()
    return out


_CONTAINER_SET, _BREAK_SET = frozenset(CONTAINERS), frozenset(BREAKS)


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """One row of numbers per block, with those of its neighbours."""
    none = Block("", 0, 0, False, False, False)
    marked = any(b.article for b in blocks)
    out = []
    for k, block in enumerate(blocks):
        before = blocks[k - 1] if k else none
        after = blocks[k + 1] if k + 1 < len(blocks) else none
        out.append(
            # Enclosure: 0 inside the article or where a page marks none, -1 outside of it.
            (
                block.words, block.density, before.words, before.density, after.words,
                after.density, float(block.boilerplate), float(block.article) - float(marked), float(block.heading),
            )
        )
    return out


# ---- the labelled pages --------------------------------------------------------------------------

_LONG = "a paragraph of the story goes on for some time and tells what was seen on that day in town"
_MENU = "".join(f'<li><a href="/{k}">item {k}</a></li>' for k in range(6))

#: (page, labels of its blocks in order: 1 is article text)
LABELLED = (
    (f"<nav><ul>{_MENU}</ul></nav><article><h1>A title</h1><p>{_LONG}</p><p>Short one.</p><p>{_LONG}<br>{_LONG}</p></article><footer>(c) a site and its owners</footer>", "0000001111" + "0"),
    (f'<header><a href="/">Site name</a><p>The best of all sites</p></header><div class="ad">Buy one of these now</div><article><h1>News of today</h1><p>Yes.</p><p>{_LONG} <a href="/x">with a link</a></p></article><footer><p>All rights reserved by us</p></footer>', "000" + "111" + "0"),
    (f'<div id="menu">{_MENU}</div><div id="content"><h1>Plain page</h1><p>{_LONG}</p><p>{_LONG}</p><p>An end.</p></div><div class="sidebar"><p>Latest posts of this blog</p><p>{_LONG}</p></div>', "000000" + "1111" + "00"),
    (f'<main><h2>Report</h2><p>{_LONG}</p><ul><li>First point made</li><li>Second point made</li></ul><p>{_LONG}</p></main><aside><h3>Most read</h3>{_MENU}</aside>', "11111" + "0000000"),
    (f'<article><p>{_LONG}</p><p>{_LONG}</p><section class="comments"><h3>Comments</h3><p>{_LONG}</p><p>Nice read</p></section></article><form><label>Your name</label><p>Leave a reply below</p></form>', "11" + "000" + "00"),
    (f'<p class="x"><a href="/">Home</a></p><p><a href="/b">Blog</a></p><p>{_LONG} {_LONG}</p><p>{_LONG} <a href="/c">see here</a> {_LONG}</p><p><a href="/d">Older</a></p><p><a href="/e">Newer</a></p>', "00" + "11" + "00"),
    (f'<div class="cookie-notice"><p>{_LONG}</p></div><div role="alert">{_LONG}</div><article><h1>Head</h1><p>{_LONG}</p><p>{_LONG}</p><div class="related">{_MENU}</div></article>', "00" + "111" + "000000"),
    (f'<article><h1>Words</h1><p>One.</p><p>Two words.</p><p>{_LONG}</p><footer>Written by a person</footer></article><div class="advert">{_LONG}</div>', "1111" + "0" + "0"),
    (f'<article><p>{_LONG}</p><ul>{_MENU}</ul><p>{_LONG}</p><p><a href="/src">The source of it</a></p><p>{_LONG}</p></article><nav>{_MENU}</nav>', "1" + "000000" + "1" + "1" + "1" + "000000"),
    (f'<article><h1>Last</h1><p>{_LONG}</p><p>The story ends here.</p>', "111"),
    (f"<p>{_LONG}</p>", "1"),
    (f'<p>{_LONG}</p><p>Fin.</p>', "11"),
    (f'<div><h1>Only</h1><p>{_LONG}</p><p>And so it ends</p></div>', "111"),
    (f'<div>Stray words above it all</div><article><p>{_LONG}</p><p>More.</p></article><div>{_LONG}</div>', "0" + "11" + "0"),
    (f'<main><p>{_LONG}</p></main><p>Some words below</p>', "1" + "0"),
    (f'<div><a href="/1">Read how the town was built</a></div><div><a href="/2">Ten things to see this week in town</a></div><h1>Top</h1><p>{_LONG}</p><p>{_LONG}</p><div><a href="/3">More stories from the town and around</a></div>', "00" + "111" + "0"),
    (f'<div><a href="/1">Part one of the long series</a></div><div><a href="/2">Part two of the long series</a></div>', "00"),
    (f'<table><tr><td><a href="/">Start</a></td><td><a href="/n">News</a></td></tr></table><p>{_LONG}</p><p>{_LONG}</p>', "00" + "11"),
)


@dataclass(frozen=True)
class Node:
    feature: int
    cut: float
    low: Node | bool
    high: Node | bool


def _impurity(labels: list[int]) -> float:
    ones = sum(labels)
    return 2 * ones * (len(labels) - ones) / len(labels) if labels else 0.0


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 6) -> Node | bool:
    """A decision tree by Gini impurity."""
    best = None
    if depth and 0 < sum(labels) < len(labels):
        for k in range(len(FEATURES)):
            values = sorted({r[k] for r in rows})
            for a, b in zip(values, values[1:], strict=False):
                cut = (a + b) / 2
                low = [y for r, y in zip(rows, labels, strict=True) if r[k] <= cut]
                high = [y for r, y in zip(rows, labels, strict=True) if r[k] > cut]
                cost = _impurity(low) + _impurity(high)
                if best is None or cost < best[0] - 1e-12:
                    best = cost, k, cut
    if best is None or best[0] >= _impurity(labels):
        return 2 * sum(labels) > len(labels)
    _, k, cut = best
    side = lambda keep: [(r, y) for r, y in zip(rows, labels, strict=True) if keep(r[k])]
    low, high = side(lambda v: v <= cut), side(lambda v: v > cut)
    branches = [grow([r for r, _ in s], [y for _, y in s], depth - 1) for s in (low, high)]
    return Node(k, cut, *branches)


@cache
def trained() -> Node | bool:
    """The tree of the labelled pages."""
    rows: list[tuple[float, ...]] = []
    labels: list[int] = []
    for page, marks in LABELLED:
        found = features(blocks_of(page))
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks, {len(marks)} labels: {page[:80]}")
        rows += found
        labels += [int(m) for m in marks]
    return grow(rows, labels)


def is_article(tree: Node | bool, row: tuple[float, ...]) -> bool:
    while isinstance(tree, Node):
        tree = tree.low if row[tree.feature] <= tree.cut else tree.high
    return tree


def main_text(page: str | None) -> str:
    """Article blocks of a page, joined by line ends."""
    blocks = blocks_of(page)
    tree = trained()
    kept = [b.text for b, row in zip(blocks, features(blocks), strict=True) if is_article(tree, row)]
    return "\n".join(kept)


def extract(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """Replace the column ``page`` by the main text; other columns stay."""
    kept = [c for c in pages.columns if c not in (page, text)]
    source = pages.select((F.struct(*kept) if kept else F.struct(F.lit(0))).alias("row"), F.col(page).alias("page"))
    schema = source.withColumn("page", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "page"):
                texts = [main_text(p) for p in part.column("page").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string())], names=["row", "page"]
                )

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in kept], F.col("page").alias(text))


@query("op8_block_tree_html")
def op8_block_tree_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
