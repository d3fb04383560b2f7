"""Blocks to chunks under a token budget: splitting of blocks that are too long, and packing under headings with overlap.

A token counter is a function from a text to the spans of its tokens, [(start, end), ...], so that texts can be cut between tokens.
It must count a join of texts by blank lines as the sum of theirs. Blocks of one document are read in order by one task with a
document's worth of memory; documents are spread over all tasks, in as many rows as there are blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.run import Tables

#: The budget of a chunk in tokens.
TARGET, OVERLAP, MOST = 360, 60, 512
Counter = Callable[[str], list[tuple[int, int]]]
WORD = re.compile(r"\w+|[^\w\s]")


def word_spans(text: str) -> list[tuple[int, int]]:
    """The counter of the queries: words and single signs."""
    return [m.span() for m in WORD.finditer(text)]


@dataclass(frozen=True)
class Piece:
    """A stretch of a block, whole or not."""

    ordinal: int
    start: int
    end: int
    text: str
    tokens: int


def split_block(ordinal: int, text: str, room: int, overlap: int, spans: Counter = word_spans) -> list[Piece]:
    """The block as one piece if it has at most room tokens, else in windows of room tokens that share up to overlap; each starts
    where a token does and after the one before. Without room for a token there are none."""
    at = spans(text)
    if len(at) <= room:
        return [Piece(ordinal, 0, len(text), text, len(at))]
    if room <= 0:
        return []
    step, out = max(1, room - max(0, overlap)), []
    for first in range(0, len(at), step):
        last = min(first + room, len(at))
        start, end = (0 if first == 0 else at[first][0]), (len(text) if last == len(at) else at[last][0])
        out.append(Piece(ordinal, start, end, text[start:end], last - first))
        if last == len(at):
            break
    return out


def tail(piece: Piece, overlap: int, spans: Counter = word_spans) -> Piece | None:
    """The last tokens of a piece that fit the overlap; none if that is the whole piece."""
    at = spans(piece.text)
    if overlap <= 0 or len(at) <= overlap:
        return None
    start = at[-overlap][0]
    return Piece(piece.ordinal, piece.start + start, piece.end, piece.text[start:], overlap)


def pack(blocks: list[tuple], target: int, overlap: int, most: int, spans: Counter = word_spans) -> tuple[list[list[Piece]], list[int]]:
    """(chunks, ordinals that can't be split) from (ordinal, heading, page, text) in order.

    A chunk ends where the heading or the page changes, before a second piece of one block, and before a piece that would lead
    over the target; in the last case the next one begins with the tail of the piece before, unless that leads over the most."""
    chunks: list[list[Piece]] = []
    failed: list[int] = []
    now: list[Piece] = []
    place = None
    for ordinal, heading, page, text in blocks:
        if not text.strip():
            continue
        head = len(spans(heading))
        pieces = split_block(ordinal, text, most - head, overlap, spans)
        if not pieces:
            failed.append(ordinal)
        for piece in pieces:
            if now and ((heading, page) != place or piece.ordinal == now[-1].ordinal):
                chunks.append(now)
                now = []
            if not now:
                now, place = [piece], (heading, page)
            elif head + sum(p.tokens for p in now) + piece.tokens <= target:
                now.append(piece)
            else:
                chunks.append(now)
                carried = tail(now[-1], overlap, spans)
                now = [carried, piece] if carried and head + carried.tokens + piece.tokens <= most else [piece]
    return chunks + [now] * bool(now), failed


def _per_document(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f from a document's id and its blocks (ordinal, heading, page, text) to rows. The blocks of a document come one after another."""
    names = ["doc_id", "ordinal", "heading", "page", "text"]
    dealt = df.select(*names).repartition("doc_id").sortWithinPartitions("doc_id", "ordinal")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, blocks, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if blocks and row[0] != doc:
                    out += f(doc, blocks)
                    blocks = []
                doc = row[0]
                blocks.append((row[1], row[2] or "", row[3], row[4] or ""))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if blocks:
            out += f(doc, blocks)
        yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.mapInArrow(run, schema)


def split_oversized_blocks(blocks: DataFrame, overlap: int = OVERLAP, most: int = MOST, spans: Counter = word_spans) -> DataFrame:
    """(doc_id, ordinal, piece, char_start, char_end, tokens, text) of blocks (doc_id, ordinal, heading, page, text).

    A piece fits the most together with its heading. A block that can't be split so has one row without piece and text. Blank
    blocks have none; null headings count as none; repeated rows are split each; extra columns are ignored."""

    def rows(doc, mine):
        for ordinal, heading, _, text in mine:
            if text.strip():
                pieces = split_block(ordinal, text, most - len(spans(heading)), overlap, spans)
                yield from ({"doc_id": doc, "ordinal": ordinal, "piece": k, "char_start": p.start, "char_end": p.end, "tokens": p.tokens, "text": p.text} for k, p in enumerate(pieces))
                if not pieces:
                    yield {"doc_id": doc, "ordinal": ordinal}

    return _per_document(blocks, rows, "doc_id long, ordinal long, piece long, char_start long, char_end long, tokens long, text string")


def heading_pack_chunks(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST, spans: Counter = word_spans) -> DataFrame:
    """(doc_id, chunk_index, heading, page, tokens, segments, text) of blocks (doc_id, ordinal, heading, page, text).

    segments are 'ordinal:start-end' of the pieces in order, in characters of their blocks; text joins them by blank lines; tokens
    counts the heading too. Documents without a block that has text and fits have no rows."""

    def rows(doc, mine):
        of = {o: (h, p) for o, h, p, _ in mine}
        for k, chunk in enumerate(pack(mine, target, overlap, most, spans)[0]):
            heading, page = of[chunk[0].ordinal]
            yield {
                "doc_id": doc,
                "chunk_index": k,
                "heading": heading,
                "page": page,
                "tokens": len(spans(heading)) + sum(p.tokens for p in chunk),
                "segments": ",".join(f"{p.ordinal}:{p.start}-{p.end}" for p in chunk),
                "text": "\n\n".join(p.text for p in chunk),
            }

    return _per_document(blocks, rows, "doc_id long, chunk_index long, heading string, page long, tokens long, segments string, text string")


def document_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents, one for each line with text; the page changes at a form feed, and a line with # is a heading."""
    line = F.posexplode(F.split("text", "\n"))
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", line.alias("ordinal", "text"))
    from pyspark.sql import Window

    so_far = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("text").rlike("^#{1,6} ")
    named = lines.withColumn("heading", F.coalesce(F.last(F.when(is_heading, F.regexp_replace("text", "^#+ +", "")), True).over(so_far), F.lit("")))
    paged = named.withColumn("page", F.sum(F.when(F.col("text").contains("\f"), 1).otherwise(0)).over(so_far).cast("long"))
    return paged.where(~is_heading & (F.trim("text") != "")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "heading", "page", "text")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized_blocks(document_blocks(Tables(spark, sf_dir)["documents"]))
    words = r"regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]', 0)"
    return pieces.select("doc_id", "ordinal", "piece", "tokens", F.expr(f"sha2(array_join({words}, ' '), 256)").alias("words_sha256"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heading_pack_chunks(document_blocks(Tables(spark, sf_dir)["documents"]))


QUERIES = {"split_oversized_blocks": _split, "heading_pack_chunks": _packed}
#: By token numbers, where the operator cuts texts. Packing is an ordered fold; tests hold it against a plain reading.
ORACLES = {
    "split_oversized_blocks": rf"""WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents WHERE doc_id IS NOT NULL),
    headed AS (SELECT *, regexp_matches(text, '^#{{1,6}} ') AS is_heading, coalesce(last_value(CASE WHEN regexp_matches(text, '^#{{1,6}} ') THEN regexp_replace(text, '^#+ +', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING), '') AS heading FROM line),
    block AS (SELECT doc_id, ordinal, {MOST} - len(regexp_extract_all(heading, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS room, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS t FROM headed WHERE NOT is_heading AND regexp_matches(text, '\S')),
    piece AS (SELECT *, greatest(1, room - {OVERLAP}) AS step, unnest(range(0, CASE WHEN len(t) <= room THEN 1 ELSE CAST(ceil((len(t) - room) / CAST(greatest(1, room - {OVERLAP}) AS DOUBLE)) AS BIGINT) + 1 END)) AS piece FROM block)
    SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, piece, CAST(least(room, len(t) - piece * step) AS BIGINT) AS tokens, sha256(array_to_string(t[piece * step + 1:least(piece * step + room, len(t))], ' ')) AS words_sha256 FROM piece""".replace("\\\\", "\\"),
}
