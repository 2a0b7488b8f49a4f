"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text at block-level tags. Pass one decides what it can: blocks in
navigation, headers, footers, sidebars, adverts, forms, notices or comments (by tag, role or class), blocks
outside the page's article where it marks one, and blocks that are mostly links are boilerplate; blocks
with enough words and a sufficient share of stop words are content. What is left, blocks that are short
or have few stop words, pass two labels like their nearest decided neighbour: the one in the smaller
enclosing part of the page first, then the one fewer blocks away; a heading follows what comes after it.
The article's tag alone never makes a block content; an article nested in the article is a reader's comment.

Defined results: null and empty html give an empty text. Where a page (or its article) has no block that
pass one decides, there is no neighbour to follow and its undecided blocks are the text, so a page of a
few short lines keeps them. A tag that isn't closed runs to the end of the page, as do comments and scripts;
the work grows with the length of the page, whatever its markup. Repeated pages and null ids each get a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop words, and what tags, roles and class words mean.
STOP = frozenset(
    "a an and are as at be by for from has have he in is it its of on or that the this to was were will with not but they you we his her she which "
    "der die das und ist ein eine zu von mit den dem des im nicht auf sich auch für als es an werden aus er hat dass sie nach bei "
    "le la les de des du et est un une en que qui dans par pour sur pas au aux avec ce se ne plus sont il elle ou "
    "el los las del y en un una que por con para es se su al lo como más o pero sus no".split()
)
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NESTING = frozenset("article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
SILENT = frozenset("script style noscript template svg iframe object select button textarea head title canvas audio video map".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CLASSES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice outbrain overlay pagination paywall popup promo promoted recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe taboola toc toolbar widget".split()
)
LONG_WORDS, SHORT_WORDS, DENSE, SPARSE, LINKED = 20, 8, 0.15, 0.05, 0.5

#: A quote opens a value only after an equals sign; a tag that doesn't match never ends.
_REST_OF_TAG = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_WORDS = re.compile(r"\w+")
_SPLIT = re.compile(r"[_-]+")
#: First parts of class names that tell of a page's layout, not of the element itself.
LAYOUT = frozenset("has have with without no not page is-not hide show".split())


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    outside: bool  # in a part that tags, roles or classes mark as boilerplate
    article: bool
    heading: bool
    shared: int  # how many enclosing elements it shares with the block before it
    label: bool | None = None


def _marked(attributes: str) -> bool:
    """Whether a tag's attributes say boilerplate or hidden."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = _SPLIT.split(word)
                if parts[0] not in LAYOUT and not CLASSES.isdisjoint(parts):
                    return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, closing, tag, attributes) of every tag; the last has the empty name. What can't be seen is left out."""
    at, size, missing = 0, len(html), set()
    text: list[str] = []
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text.append(html[at:])
            break
        text.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
        elif name := _NAME.match(html, lt + 1):
            rest = _REST_OF_TAG.match(html, name.end())
            if not rest:
                break
            closing, tag, at = bool(name[1]), name[2].lower(), rest.end()
            if tag in SILENT:
                if not closing and not rest[1].rstrip().endswith("/"):
                    end = None if tag in missing else re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    if end:
                        at = end.start()
                    else:
                        missing.add(tag)
                        if tag not in ("head", "title"):
                            break
                continue
            yield "".join(text), closing, tag, rest[1]
            text = []
        else:
            text.append("<")
            at = lt + 1
    yield "".join(text), False, "", ""


def blocks_of(html: str) -> list[Block]:
    found: list[Block] = []
    # tag, boilerplate by tag, boilerplate by class, article and main tags and article tags alone, with this one
    stack: list[tuple[str, bool, bool, int, int]] = []
    text: list[str] = []
    linked = opened = lowest = 0
    link = -1  # how many blocks had been opened when the link began
    leaf_marked = heading = False

    def flush() -> None:
        nonlocal text, linked, lowest
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            _, bad, marked, articles, _ = stack[-1] if stack else ("", False, False, 0, 0)
            found.append(Block(joined, linked, leaf_marked or bad or marked, articles > 0, heading, min(lowest, len(stack))))
            lowest = len(stack)
        text, linked = [], 0

    for piece, closing, tag, attributes in _tags(html):
        if piece:
            text.append(piece)
            if link >= 0:
                linked += len(" ".join(unescape(piece).split()))
        if tag == "a":
            link = -1 if closing or "href" not in attributes.lower() else opened
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing and link == opened:
            link = -1
        opened += not closing
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag != "hr"
        leaf_marked = tag not in NESTING and not closing and bool(attributes) and _marked(attributes)
        if tag in NESTING and closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            lowest = min(lowest, len(stack))
        elif tag in NESTING:
            _, bad, marked, articles, own = stack[-1] if stack else ("", False, False, 0, 0)
            if tag in ("article", "main"):  # the outermost one stands apart from a class around it
                bad, marked = bad or tag == "article" and own > 0, marked and articles > 0
            else:
                bad, marked = bad or tag in BOILERPLATE or (tag == "header" and not articles), marked or (bool(attributes) and _marked(attributes))
            stack.append((tag, bad, marked, articles + (tag in ("article", "main")), own + (tag == "article")))
    flush()
    return found


def _decide(block: Block, has_article: bool) -> bool | None:
    """Pass one."""
    if block.outside or has_article and not block.article or block.linked > LINKED * len(block.text):
        return False
    words = _WORDS.findall(block.text.lower())
    dense = sum(w in STOP for w in words) / max(1, len(words))
    if len(words) >= LONG_WORDS and dense >= SPARSE or len(words) >= SHORT_WORDS and dense >= DENSE and not block.heading:
        return True
    return None


def label(blocks: list[Block], first_pass: bool = True, second_pass: bool = True) -> None:
    """Sets the labels. A pass that is left out decides nothing (the first) or leaves out what is undecided (the second)."""
    has_article = any(b.article and not b.outside for b in blocks)
    for b in blocks:
        b.label = _decide(b, has_article) if first_pass else None
    if second_pass:
        _inherit(blocks, has_article)


def _inherit(blocks: list[Block], has_article: bool) -> None:
    """Pass two, in a sweep to either side: (shared elements, minus distance, label) of the nearest decided neighbour there."""
    after: list[tuple[int, int, bool] | None] = [None] * len(blocks)
    near = None
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = near
        if blocks[i].label is not None:
            near = (1 << 30, 0, blocks[i].label)
        if near:
            near = (min(near[0], blocks[i].shared), near[1] - 1, near[2])
    near, nothing = None, not any(b.label for b in blocks)
    for i, b in enumerate(blocks):
        if near:
            near = (min(near[0], b.shared), near[1] - 1, near[2])
        if b.label is not None:
            near = (1 << 30, 0, b.label)
            continue
        if nothing or not (near or after[i]):
            b.label = True
        elif near and after[i]:
            next_one = after[i]
            follows = next_one[0] > near[0] or next_one[0] == near[0] and (b.heading or next_one[1] > near[1] or next_one[1] == near[1] and next_one[2])
            b.label = next_one[2] if follows else near[2]
        else:
            b.label = (near or after[i])[2]


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id, url, text, n_chars."""

    @F.arrow_udf("string")
    def text_of(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in html:
            yield pa.array([main_text(h) for h in x.to_pylist()], pa.string())

    return pages.select(F.col(id_col), F.col(url_col), text_of(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
