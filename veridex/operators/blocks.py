"""Documents to blocks: markdown by a fold over lines with a stack of containers, web pages by a fold over tags with depths.

A document is one row and is read in order; nothing is shuffled, and a task holds one document's blocks. A block's heading path is
the headings it stands under, joined by HEADING_MARK; an empty heading only ends deeper ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.run import Tables, oracle

HEADING_MARK = " / "
SCHEMA = "ordinal long, kind string, heading_path string, text string, start_line long, end_line long, list_depth long, code_info string"


@dataclass
class Headings:
    """Open headings (level, title), outermost first."""

    open: list[tuple[int, str]] = field(default_factory=list)

    def add(self, level: int, title: str) -> None:
        self.open = [h for h in self.open if h[0] < level] + ([(level, title)] if title else [])

    def path(self) -> str:
        return HEADING_MARK.join(t for _, t in self.open)


# Inline markup.
CODE_OR_ESCAPE = re.compile(r"(`+)(?!`)(.*?[^`])\1(?!`)|\\([!-/:-@\[-`{-~])|<((?:https?|ftp|mailto):[^\s<>]*)>|</?[A-Za-z][^<>]*>|<!--.*?-->|<[?!][^>]*>|(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?:<[^<>]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)", re.S)
STRONG = re.compile(r"(?<![\w*])(\*{1,3})(?![\s*])(.+?)(?<![\s*])\1(?!\*)|(?<![\w_])(_{1,3})(?![\s_])(.+?)(?<![\s_])\3(?![\w])", re.S)
HARD_BREAK = re.compile(r"(?: {2,}|\\)\n[ \t]*")


def inline_text(source: str) -> str:
    """What inline markup says: code and link text, the text that stands for a picture, characters behind references and
    backslashes; tags are left out, a line break is a blank. Links by reference stay as they are written."""
    kept: list[str] = []

    def hold(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x00"

    def one(m: re.Match) -> str:
        if m[1]:
            code = m[2].replace("\n", " ")
            return hold(code[1:-1] if code.startswith(" ") and code.endswith(" ") and code.strip() else code)
        if m[3]:
            return hold(m[3])
        if m[4]:
            return hold(m[4])
        return inline_text(m[6]) if m[6] is not None else ""

    if not re.search(r"[`\\<\[*_&\n]", source):
        return source
    text = CODE_OR_ESCAPE.sub(one, HARD_BREAK.sub("\x01", source.replace("\x00", "�")))
    before = None
    while before != text:
        before, text = text, STRONG.sub(lambda m: m[2] or m[4], text)
    text = unescape(text) if "&" in text else text
    text = re.sub(r"[ \t]*\n[ \t]*", " ", text).replace("\x01", "\n")
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


# Lines of markdown.
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])([ \t]+|$)")
QUOTE = re.compile(r" {0,3}> ?")
#: Where a stretch of raw HTML begins, and where it ends (a blank line unless said otherwise).
RAW = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
)
RAW_BLOCK = re.compile(r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)", re.I)
RAW_TAG = re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$")


@dataclass
class Container:
    """A quote, or a list item whose content begins at a column; saved: the headings from before it."""

    item: bool
    column: int
    saved: list[tuple[int, str]]
    sign: str = ""


class Lines:
    """The fold: what is open after the lines so far, and the blocks that are done."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.containers: list[Container] = []
        self.headings = Headings()
        self.kind, self.lines, self.first, self.last = "", [], 0, 0
        self.fence, self.info, self.raw_end = "", "", None

    def close(self) -> None:
        """Ends the open leaf."""
        kind, lines, self.kind, self.lines = self.kind, self.lines, "", []
        if kind == "code":
            while lines and not lines[-1].strip() and not self.fence:
                lines.pop()
            text = "\n".join(lines).rstrip("\n")
        elif kind == "text":
            text = inline_text("\n".join(x.strip() if k == len(lines) - 1 else x.lstrip() for k, x in enumerate(lines))).strip()
        else:
            return
        if not text.strip():
            return
        depth = sum(c.item for c in self.containers)
        name = "code_block" if kind == "code" else "list_item" if depth else "paragraph"
        last = self.last if self.fence or kind == "text" else self.first + len(lines) - 1
        self.blocks.append({"ordinal": len(self.blocks), "kind": name, "heading_path": self.headings.path(), "text": text, "start_line": self.first, "end_line": last, "list_depth": depth, "code_info": (self.info or None) if kind == "code" else None})

    def leave(self, n: int) -> None:
        """Ends all but the first n containers; headings in them are forgotten."""
        if len(self.containers) > n:
            self.close()
            self.headings.open = self.containers[n].saved
            del self.containers[n:]

    def begin(self, kind: str, number: int, text: str | None = None) -> None:
        self.close()
        self.kind, self.first, self.last, self.fence, self.info = kind, number, number, "", ""
        self.lines = [] if text is None else [text]

    def add(self, number: int, line: str) -> None:
        line = line.expandtabs(4)
        held = 0
        for c in self.containers:
            if c.item:
                if line.strip() and len(line) - len(line.lstrip()) < c.column:
                    break
                line = line[c.column :] if line.strip() else ""
            else:
                m = QUOTE.match(line)
                if not m:
                    break
                line = line[m.end() :]
            held += 1
        whole = held == len(self.containers)
        if self.kind == "code" and self.fence:
            if whole:
                self._in_fence(number, line)
                return
            self.leave(held)
        if self.kind == "raw" and whole:
            self._in_raw(line)
            return
        blank = not line.strip()
        if blank:
            if not whole and any(not c.item for c in self.containers[held:]):
                self.leave(held)
            elif self.kind == "code":
                self.lines.append(line[4:])
            elif self.kind != "raw" or self.raw_end is None:
                self.close()
            return
        start = self._starts(line, whole)
        if not whole and not start and self.kind == "text":
            self.lines.append(line)  # a paragraph goes on lazily
            self.last = number
            return
        self.leave(held)
        while start in ("quote", "item"):
            line = self._open(start, line, number)
            start = self._starts(line, True) if line.strip() else ""
        if not line.strip():
            return
        self._leaf(start, number, line)

    def _starts(self, line: str, whole: bool) -> str:
        """What begins in a line; an empty string for more of a paragraph."""
        if len(line) - len(line.lstrip(" ")) >= 4:
            return "" if self.kind == "text" else "indented"
        if QUOTE.match(line):
            return "quote"
        if FENCE.match(line):
            return "fence"
        if HEADING.match(line):
            return "heading"
        if self.kind == "text" and whole and UNDERLINE.match(line):
            return "underline"
        if RULE.match(line):
            return "rule"
        m = ITEM.match(line)
        if m and not (self.kind == "text" and whole and not self._in_list_of(m) and (not line[m.end() :].strip() or m[3] not in (None, "1"))):
            return "item"
        if any(begin.match(line) for begin, _ in RAW) or RAW_BLOCK.match(line) or (self.kind != "text" and RAW_TAG.match(line)):
            return "raw"
        return ""

    def _in_list_of(self, m: re.Match) -> bool:
        return bool(self.containers) and self.containers[-1].item

    def _open(self, start: str, line: str, number: int) -> str:
        self.close()
        if start == "quote":
            self.containers.append(Container(False, 0, self.headings.open))
            return line[QUOTE.match(line).end() :]
        m = ITEM.match(line)
        rest = line[m.end() :]
        gap = len(m[4]) if rest.strip() and len(m[4]) <= 4 else 1
        column = len(m[1]) + len(m[2]) + gap
        self.containers.append(Container(True, column, self.headings.open, m[2][-1]))
        return line[column:] if rest.strip() else ""

    def _leaf(self, start: str, number: int, line: str) -> None:
        if start == "heading":
            self.close()
            m = HEADING.match(line)
            self.headings.add(len(m[1]), inline_text((m[2] or "").strip()).strip())
        elif start == "underline":
            title = inline_text("\n".join(x.strip() for x in self.lines)).strip()
            self.kind, self.lines = "", []
            self.headings.add(1 if "=" in line else 2, title)
        elif start == "rule":
            self.close()
        elif start == "fence":
            self.begin("code", number)
            m = FENCE.match(line)
            self.fence, self.info = m[1], unescape(m[2])
            self.indent = len(line) - len(line.lstrip(" "))
        elif start == "raw":
            self.begin("raw", number)
            self.raw_end = next((end for begin, end in RAW if begin.match(line)), None)
            self._in_raw(line)
        elif start == "indented":
            if self.kind != "code":
                self.begin("code", number)
            self.lines.append(line[4:])
        elif self.kind == "text":
            self.lines.append(line)
            self.last = number
        else:
            self.begin("text", number, line)

    def _in_fence(self, number: int, line: str) -> None:
        m = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*$", line)
        self.last = number
        if m and m[1][0] == self.fence[0] and len(m[1]) >= len(self.fence):
            self.close()
        else:
            self.lines.append(line[min(self.indent, len(line) - len(line.lstrip(" "))) :])

    def _in_raw(self, line: str) -> None:
        if self.raw_end.search(line) if self.raw_end else not line.strip():
            self.kind = ""


def markdown(text: str) -> list[dict]:
    """Blocks of a markdown text: paragraphs, list items and code with their lines (from 1, both ends included).

    Headings of six levels and underlined ones, quotes, nested lists, fenced and indented code, raw HTML (left out), lazy lines.
    Definitions of links by reference and tables are text like other text."""
    fold = Lines()
    lines = re.split(r"\r\n|\n|\r", text.removeprefix("﻿"))
    for number, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):
        fold.add(number, line)
    fold.leave(0)
    fold.close()
    return fold.blocks


# Elements of web pages, as fixed by the public HTML standard or by the rules for blocks.
REMOVED = frozenset(("script", "style", "template", "noscript", "nav", "aside", "header", "footer"))
BLOCKS = {"p": "paragraph", "li": "list_item", "pre": "code_block", "blockquote": "blockquote"}
TITLES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = ("ul", "ol")
ENDS_P = frozenset("address article aside blockquote div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tags(HTMLParser):
    """The fold over tags: how deep each kind of element is open, and what is read since an outermost block or a heading began."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.depth = dict.fromkeys((*REMOVED, *BLOCKS, *TITLES, *LISTS, "main", "article", "body"), 0)
        self.seen = {"main": 0, "article": 0}
        #: (kind, text parts, list depth, in the first main, in the first article)
        self.found: list[list] = []
        self.reading: list[tuple[str, int, list[str]]] = []

    def _removed(self) -> bool:
        return any(self.depth[t] for t in REMOVED)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P and "p" in self.open:
            self._end("p", ("li", "blockquote", "td", "th", "div", "table", "button"))
        if tag == "li":
            self._end("li", LISTS)
        if tag in EMPTY:
            return
        removed = self._removed() or tag in REMOVED
        if tag in self.seen and not removed and not self.depth[tag]:
            self.seen[tag] += 1
        self.open.append(tag)
        if tag in self.depth:
            self.depth[tag] += 1
        if removed:
            return
        outermost = tag in BLOCKS and sum(self.depth[t] for t in BLOCKS) == 1
        if outermost or tag in TITLES:
            parts: list[str] = []
            lists = sum(self.depth[t] for t in LISTS) if tag == "li" else 0
            first = [self.seen[t] == 1 and self.depth[t] > 0 for t in ("main", "article")]
            self.found.append([tag, parts, lists, *first])
            self.reading.append((tag, len(self.open), parts))

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, ())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def _end(self, tag: str, within: tuple[str, ...]) -> None:
        """Ends the innermost open element of this name, if none of `within` stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag:
                for name in self.open[k:]:
                    if name in self.depth:
                        self.depth[name] -= 1
                del self.open[k:]
                self.reading = [r for r in self.reading if r[1] <= k]
                return
            if self.open[k] in within:
                return

    def handle_data(self, data: str) -> None:
        if self.reading and not self._removed():
            for _, _, parts in self.reading:
                parts.append(data)


def web(source: str) -> list[dict]:
    """Blocks of a page in its first main, else its first article, else all of it: paragraphs, list items, preformatted text and
    quotes, each only as the outermost block. White space is folded but for preformatted text."""
    tags = Tags()
    tags.feed(source)
    tags.close()
    root = 3 if tags.seen["main"] else 4 if tags.seen["article"] else None
    out, headings = [], Headings()
    for tag, parts, lists, *first in tags.found:
        if root and not first[root - 3]:
            continue
        folded = " ".join(" ".join(parts).split())
        if tag in TITLES:
            headings.add(int(tag[1]), folded)
            continue
        text = "".join(parts).strip("\n").rstrip() if tag == "pre" else folded
        if text:
            out.append({"ordinal": len(out), "kind": BLOCKS[tag], "heading_path": headings.path(), "text": text, "list_depth": lists})
    return out


def _blocks(df: DataFrame, key: str, column: str, read: Callable[[str], list[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [{key: k, **b} for b in read(text or "")]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.select(key, column).mapInArrow(run, schema)


def markdown_blocks(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A row for each block of docs: the key, ordinal from 0, kind, heading_path, text, start_line, end_line, list_depth, code_info.

    Null and empty texts have no blocks; rows without a key and repeated rows are read like others; extra columns are ignored."""
    return _blocks(docs, key, column, markdown)


def html_blocks(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """A row for each block of pages, as markdown_blocks gives them, without lines."""
    return _blocks(pages, key, column, web)


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = markdown_blocks(Tables(spark, sf_dir)["markdown_text"])
    return blocks.select("doc_id", "ordinal", "kind", "heading_path", "start_line", "end_line", "list_depth", F.sha2("text", 256).alias("text_sha"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_blocks(Tables(spark, sf_dir)["pages"])
    return blocks.select("page_id", "ordinal", "kind", "heading_path", "list_depth", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("long").alias("n_chars"))


QUERIES = {"markdown_blocks": _markdown, "html_blocks": _html}

#: The same for what the tables hold, by running sums over lines: marks at the start of lines, fences in pairs, no markup in lines.
MARKDOWN_SQL = r"""WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM @markdown_text),
    fenced AS (SELECT *, line = '```' AS mark, sum(CASE WHEN line = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS fences FROM line),
    kinds AS (SELECT *, CASE WHEN mark OR fences % 2 = 1 THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,2} ') THEN 'heading' WHEN line LIKE '- %' THEN 'item' WHEN line LIKE '> %' THEN 'quote' ELSE 'more' END AS kind FROM fenced),
    led AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM kinds),
    run AS (SELECT *, sum(CASE WHEN kind = 'code' THEN CASE WHEN mark AND fences % 2 = 1 THEN 1 ELSE 0 END WHEN kind IN ('blank', 'heading', 'item') OR kind = 'quote' AND before IS DISTINCT FROM 'quote' OR kind = 'more' AND coalesce(before, 'blank') IN ('blank', 'heading', 'code') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run,
        last_value(CASE WHEN kind = 'heading' AND line LIKE '# %' THEN place END IGNORE NULLS) OVER w AS at1, last_value(CASE WHEN kind = 'heading' AND line LIKE '## %' THEN place END IGNORE NULLS) OVER w AS at2,
        last_value(CASE WHEN kind = 'heading' AND line LIKE '# %' THEN trim(substr(line, 3)) END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN kind = 'heading' AND line LIKE '## %' THEN trim(substr(line, 4)) END IGNORE NULLS) OVER w AS h2
        FROM led WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
    block AS (SELECT doc_id, run, arg_min(kind, place) AS kind, min(place) + 1 AS start_line, max(place) + 1 AS end_line, min(h1) AS h1, min(CASE WHEN at2 > coalesce(at1, -1) THEN h2 END) AS h2,
        coalesce(string_agg(CASE WHEN kind = 'code' AND NOT mark THEN line END, chr(10) ORDER BY place), string_agg(CASE WHEN kind IN ('item', 'quote') THEN trim(substr(line, 3)) WHEN kind <> 'code' THEN trim(line) END, ' ' ORDER BY place)) AS text FROM run WHERE kind NOT IN ('blank', 'heading') GROUP BY doc_id, run)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS ordinal, CASE kind WHEN 'code' THEN 'code_block' WHEN 'item' THEN 'list_item' ELSE 'paragraph' END AS kind,
        concat_ws(' / ', h1, h2) AS heading_path, start_line, end_line, CASE WHEN kind = 'item' THEN CAST(1 AS BIGINT) ELSE 0 END AS list_depth, sha256(rtrim(text, chr(10))) AS text_sha FROM block WHERE trim(replace(text, chr(10), '')) <> ''"""
#: The same for pages of the tables' form: an article with one heading, whose paragraphs don't nest.
HTML_SQL = r"""WITH article AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages),
    part AS (SELECT page_id, regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1) AS h, unnest(string_split(a, '<p>')[2:]) AS p, unnest(range(len(string_split(a, '<p>')) - 1)) AS place FROM article),
    folded AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS h, trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM part),
    plain AS (SELECT page_id, place, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS h,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS p FROM folded)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS ordinal, 'paragraph' AS kind, h AS heading_path, CAST(0 AS BIGINT) AS list_depth, sha256(p) AS text_sha, CAST(length(p) AS BIGINT) AS n_chars FROM plain WHERE p <> ''"""
ORACLES = {"markdown_blocks": oracle(lambda _: MARKDOWN_SQL), "html_blocks": oracle(lambda _: HTML_SQL)}
