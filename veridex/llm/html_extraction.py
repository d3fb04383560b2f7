"""The main text of web pages by ratios of tag paths.

A page becomes a list of blocks: stretches of text between the borders of block elements. A block's tag path is the list of
block elements from the root to it. For each path, text length and punctuation are added up over its blocks. Means of a path
are smoothed along the tree of paths (a path leans on its parent's subtree, that one on its own parent's, and so on), then
fused to one score, which falls with the share of linked text. Paths whose score reaches a part of the mean score of the page's
text are content. What content blocks share as their innermost main element, or the innermost element that holds nearly all of
them, is where the article is; short blocks in it that are no menus come along, so headings, lists and tables aren't lost.

Elements that can't be main text by their name, role or class (navigation, adverts, comments, forms, ...) take no part."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# Kinds of elements of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
#: A start tag ends open elements of these names, up to the nearest one that holds them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table body html article section div td th main aside nav header footer form blockquote figure fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never main text.
NEVER = frozenset("head title script style noscript template svg nav footer aside iframe object canvas select button textarea dialog menu xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
FRAMES = frozenset("header masthead footer topbar".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs consent cookie cookies
    gdpr modal popup overlay menu nav navbar navigation newsletter subscribe subscription signup notice notices notification alert pager
    pagination promo promos promoted promotion related recommended recommendations share sharing sharebar social sidebar rail skip
    sponsor sponsored sponsors toolbar widget widgets login""".split()
)
MAIN = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article post entry story content".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：？！،؟۔।]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
#: A path is content from this part of the mean score of the page's text on.
LEAST_SCORE = 0.25
#: The article's place holds this part of content text.
HOLDS, MAIN_HOLDS = 0.9, 0.5


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    block: bool
    marked: str = ""
    main: bool = False


@dataclass(slots=True)
class Block:
    element: int
    path: int
    tag: str
    text: str
    links: int


@dataclass(slots=True)
class Page:
    """Elements in the order of their start tags, paths as a tree (parents come first), and blocks in page order."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, True)])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[Block] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def mark(tag: str, own: dict[str, str], in_main: bool) -> str:
    """Why an element is no main text: 'never', 'comment', 'frame' or 'mark'; an empty string if nothing says so."""
    if tag in NEVER or "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return "never"
    if tag in ("html", "body", "main"):
        return ""
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{own.get('class', '')} {own.get('id', '')}").lower()))
    if words & COMMENTS:
        return "comment"
    if own.get("role", "") in ROLES:
        return "mark"
    if tag == "form":
        return "mark"
    if (tag == "header" and not in_main) or (words & FRAMES and tag not in HEADINGS and not (in_main or words & ARTICLE_WORDS)):
        return "frame"
    return "mark" if words & MARKS and tag != "article" else ""


def parse(source: str) -> Page:
    """A forgiving reading: unknown end tags are passed over, elements left open end with what holds them."""
    page = Page()
    steps: dict[tuple[int, str], int] = {}
    stack, parts, links, at = [0], [], 0, 0
    in_link, hidden = False, 0
    elements, is_open = page.elements, Counter()

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            k = next(i for i in reversed(stack) if elements[i].block) if elements[stack[-1]].tag in INLINE else stack[-1]
            page.blocks.append(Block(stack[-1], elements[k].path, elements[k].tag, text, min(links, len(text))))
        parts.clear()
        links = 0

    def words(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                links += len(text.strip())

    def end(k: int) -> None:
        """Ends the open elements from place k of the stack on."""
        nonlocal hidden
        for i in stack[k:]:
            is_open[elements[i].tag] -= 1
            hidden -= not elements[i].block
        del stack[k:]

    def close(names: Iterable[str], until: frozenset) -> None:
        """Ends the outermost open element of these names inside the nearest holder."""
        k = found = len(stack)
        while k > 1 and any(is_open[x] for x in names) and elements[stack[k - 1]].tag not in until:
            k -= 1
            if elements[stack[k]].tag in names:
                found = k
        end(found)

    while at < len(source):
        m = TOKEN.search(source, at)
        if not m:
            words(source[at:])
            break
        words(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if m[1]:
            if tag == "a":
                in_link = False
            k = len(stack) - 1 if is_open[tag] else 0
            while k and elements[stack[k]].tag != tag and not (inline and elements[stack[k]].block):
                k -= 1
            if k and elements[stack[k]].tag == tag:
                if not inline or elements[stack[k]].marked:
                    flush()
                if not inline:
                    in_link = in_link and tag in ("li", "p", "div", "span")
                end(k)
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
                close(("p",), HOLDERS)
            continue
        own = attributes(m[3])
        if not inline:
            flush()
            if tag in CLOSES_P:
                close(("p",), HOLDERS)
            if tag in ENDS:
                close(ENDS[tag], HOLDERS - {"td", "th"} if tag in ("td", "th", "tr", "tbody", "tfoot") else HOLDERS)
        elif tag == "a":
            in_link = "href" in own
        top = elements[stack[-1]]
        why = mark(tag, own, top.main) if own or not inline else ""
        if inline:
            if not why and not hidden:
                continue  # only inline elements that are left out, and what they hold, need to be told apart
            flush()
            hidden += 1
        path = top.path
        if not inline:
            label = f"{tag}.{own['class'].split()[0]}" if own.get("class", "").strip() and tag not in HEADINGS and tag not in ("p", "li", "td", "th", "tr") else tag
            path = steps.setdefault((top.path, label), len(page.parents))
            if path == len(page.parents):
                page.parents.append(top.path)
        is_main = (tag in MAIN or own.get("role") == "main" or own.get("itemprop") == "articleBody") and not why
        elements.append(Element(tag, stack[-1], path, not inline, why, top.main or is_main))
        if (is_main and not top.main) or (tag == "h1" and not why):
            _spare(elements, stack, is_main)
        if not (m[3].endswith("/") and tag in ("svg", "path")):
            stack.append(len(elements) - 1)
            is_open[tag] += 1
        if tag in RAW:
            close_tag = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = close_tag.end() if close_tag else len(source)
            end(len(stack) - 1)
    flush()
    return page


def _spare(elements: list[Element], stack: list[int], is_main: bool) -> None:
    """An element around the article isn't left out for its class alone; comments and page headers stay out."""
    for k in reversed(stack):
        if elements[k].marked in ("never", "comment") or (elements[k].marked == "frame" and not is_main):
            return
        if elements[k].marked in ("mark", "frame"):
            elements[k].marked = ""


def scores(blocks: list[Block], parents: list[int]) -> list[float]:
    """The fused score of each path: mean length times one more than mean punctuation, both smoothed along the tree of paths,
    times the share of text without links."""
    n = len(parents)
    own = [[0, 0, 0, 0] for _ in range(n)]
    for b in blocks:
        x = own[b.path]
        x[0] += 1
        x[1] += len(b.text)
        x[2] += len(PUNCTUATION.findall(b.text))
        x[3] += b.links
    below = [x[:] for x in own]
    for k in range(n - 1, 0, -1):
        for i in range(3):
            below[parents[k]][i] += below[k][i]
    subtree = [(below[0][1] / max(1, below[0][0]), below[0][2] / max(1, below[0][0]))] * n
    out = [0.0] * n
    for k in range(n):
        if k:
            count, length, signs, _ = below[k]
            up = subtree[parents[k]]
            subtree[k] = ((length + up[0]) / (count + 1), (signs + up[1]) / (count + 1))
        count, length, signs, linked = own[k]
        if count:
            up = subtree[parents[k]] if k else subtree[0]
            out[k] = (length + up[0]) / (count + 1) * (1 + (signs + up[1]) / (count + 1)) * (1 - linked / length)
    return out


def _holder(page: Page, blocks: list[Block], chosen: list[bool]) -> int:
    """The innermost main element with most content text, else the innermost element with nearly all of it."""
    held = [0] * len(page.elements)
    for b, good in zip(blocks, chosen, strict=True):
        held[b.element] += len(b.text) * good
    for k in range(len(held) - 1, 0, -1):
        held[page.elements[k].parent] += held[k]
    total = held[0]
    inner = [k for k, e in enumerate(page.elements) if (e.tag in MAIN or e.main and not page.elements[e.parent].main) and not e.marked and held[k] >= MAIN_HOLDS * total]
    if inner:
        return inner[-1]
    return max(k for k, e in enumerate(page.elements) if held[k] >= HOLDS * total and (e.block or k == 0) and e.tag not in HEADINGS and e.tag not in ("p", "li"))


def main_text(source: str) -> str:
    """The blocks of the page's article, joined by blanks."""
    page = parse(source)
    out: list[bool] = []
    for e in page.elements:  # parents come first
        out.append(bool(e.marked) or (e.parent >= 0 and out[e.parent]))
    blocks = [b for b in page.blocks if not out[b.element]]
    if not blocks:
        return ""
    score = scores(blocks, page.parents)
    chars = sum(len(b.text) for b in blocks)
    least = LEAST_SCORE * sum(score[b.path] * len(b.text) for b in blocks) / chars
    chosen = [score[b.path] >= least and score[b.path] > 0 for b in blocks]
    if not any(chosen):
        return ""
    root = _holder(page, blocks, chosen)
    inside = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        inside[k] = k == root or (e.parent >= 0 and inside[e.parent])
    whole = page.elements[root].main
    places = [k for k, good in enumerate(chosen) if good and inside[blocks[k].element]]
    first, last = places[0], places[-1]
    while not whole and first and blocks[first - 1].tag in HEADINGS and inside[blocks[first - 1].element]:
        first -= 1
    kept = []
    for k, b in enumerate(blocks):
        if not inside[b.element]:
            continue
        menu = 2 * b.links >= len(b.text)
        between = first <= k <= last and b.tag not in ("div", "section", "span", "body")
        if chosen[k] or (not menu and (whole or between)):
            kept.append(b.text)
    return " ".join(kept)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _rows(batch: pa.RecordBatch) -> Iterable[dict]:
    ids, urls, pages = (batch.column(k).to_pylist() for k in range(3))
    texts = [main_text(p) if p else "" for p in pages]
    yield {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Null and empty pages, and pages without text that could be an article, give an empty text. Null ids and URLs are passed
    on, repeated rows each give a row, extra columns are ignored. Rows are worked on one by one; nothing is shuffled, and the
    work on a page grows with its length."""
    return common.map_arrow(pages.select("page_id", "url", "html"), _rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(common.table(spark, sf_dir, "pages"))
