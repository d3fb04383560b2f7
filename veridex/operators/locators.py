"""Where a chunk comes from: one wide type for the locators of markdown (lines), PDF (pages), DOCX (cells) and web (URLs), built
from packed chunks and their blocks, written as JSON and read back with a reason for what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixtures import DERIVED
from ..plans.run import Tables, apply, oracle
from ..plans.shared import kept
from .blocks import markdown_blocks
from .chunking import heading_pack_chunks

# The version of each kind's locator.
VERSIONS = {"markdown": 1, "pdf": 2, "docx": 3, "web": 4}
CELL = "STRUCT<grid_column: BIGINT, grid_span: BIGINT, char_start: BIGINT, char_end: BIGINT>"
SEGMENT = f"STRUCT<block_ordinal: BIGINT, block_char_start: BIGINT, block_char_end: BIGINT, page: BIGINT, paragraph_index: BIGINT, table_index: BIGINT, row_index: BIGINT, cells: ARRAY<{CELL}>>"
#: A kind's members that others lack are null there.
LOCATOR = f"""STRUCT<locator_version: INT, source_type: STRING, parser_version: STRING, source_sha256: STRING, start_line: BIGINT, end_line: BIGINT, pages: ARRAY<BIGINT>,
    source_url: STRING, final_url: STRING, fetched_at: STRING, block_ordinals: ARRAY<BIGINT>, segments: ARRAY<{SEGMENT}>>"""


def chunk_locators(chunks: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, locator) for chunks (doc_id, chunk_index, segments as heading_pack_chunks gives them).

    blocks: doc_id, ordinal, start_line, end_line, page, paragraph_index, table_index, row_index, cells; documents: doc_id,
    source_type, parser_version, source_sha256, source_url, final_url, fetched_at. A group is the pieces of one chunk. Chunks of
    documents that aren't there, or of another kind, have no row; blocks that aren't there are left out of their chunk."""
    part = F.transform(F.split("segments", ","), lambda s: F.transform(F.split(s, "[:-]"), lambda x: x.cast("long")))
    pieces = chunks.select("doc_id", "chunk_index", F.posexplode(part).alias("at", "x")).select("doc_id", "chunk_index", "at", F.col("x")[0].alias("ordinal"), F.col("x")[1].alias("a"), F.col("x")[2].alias("b"))
    names = ["start_line", "end_line", "page", "paragraph_index", "table_index", "row_index", "cells"]
    spanned = pieces.join(blocks.select("doc_id", "ordinal", *names), ["doc_id", "ordinal"]).join(documents.select("doc_id", "source_type"), "doc_id")

    def only(kind: str, column: str) -> Column:
        return F.when(F.col("source_type") == kind, F.col(column)).alias(column)

    docx = [only("docx", c) for c in ("paragraph_index", "table_index", "row_index", "cells")]
    segment = F.struct(F.col("ordinal").alias("block_ordinal"), F.col("a").alias("block_char_start"), F.col("b").alias("block_char_end"), only("pdf", "page"), *docx)
    held = spanned.groupBy("doc_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", segment.alias("s")))), lambda x: x["s"]).alias("segments"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    every = held.join(documents, "doc_id").where(F.col("source_type").isin(*VERSIONS))
    version = F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair])[F.col("source_type")]
    pages = F.array_distinct(F.filter(F.col("segments.page"), lambda p: p.isNotNull()))
    locator = F.struct(
        version.alias("locator_version"), "source_type", "parser_version", "source_sha256", only("markdown", "start_line"), only("markdown", "end_line"), F.when(F.col("source_type") == "pdf", pages).alias("pages"),
        only("web", "source_url"), only("web", "final_url"), only("web", "fetched_at"), F.array_distinct(F.col("segments.block_ordinal")).alias("block_ordinals"), "segments",
    )
    return every.select("doc_id", "chunk_index", locator.cast(" ".join(LOCATOR.split())).alias("locator"))


def locator_json(locator: Column | str) -> Column:
    """The locator as JSON without members that are null."""
    return F.to_json(locator)


def read_locator(json: Column | str) -> Column:
    """The locator of JSON that locator_json wrote; null for what is none."""
    return F.from_json(json, " ".join(LOCATOR.split()))


def _positive(x: str) -> str:
    return f"coalesce(schema_of_variant({x}) = 'BIGINT' AND try_cast({x} AS BIGINT) >= 1, false)"


#: Members one by one: types are looked at, never converted.
TYPED = f"""WITH parsed AS (SELECT locator_id, try_parse_json(json) AS v FROM @locator_json), maps AS (SELECT *, CASE WHEN schema_of_variant(v) LIKE 'OBJECT<%' THEN CAST(v AS MAP<STRING, VARIANT>) END AS m FROM parsed),
    member AS (SELECT *, CASE WHEN schema_of_variant(m['source_type']) = 'STRING' THEN CAST(m['source_type'] AS STRING) END AS kind, CASE WHEN schema_of_variant(m['parser_version']) = 'STRING' THEN CAST(m['parser_version'] AS STRING) END AS parser,
        CASE WHEN schema_of_variant(m['heading_path']) LIKE 'ARRAY<%' THEN CAST(m['heading_path'] AS ARRAY<VARIANT>) END AS headings, CASE WHEN schema_of_variant(m['pages']) LIKE 'ARRAY<%' THEN CAST(m['pages'] AS ARRAY<VARIANT>) END AS pages FROM maps),
    judged AS (SELECT *, CASE WHEN v IS NULL THEN 'NO_JSON' WHEN m IS NULL THEN 'NO_OBJECT' WHEN coalesce(parser, '') = '' THEN 'BAD_PARSER_VERSION' WHEN kind = 'markdown' THEN CASE WHEN map_contains_key(m, 'heading_path') AND (headings IS NULL OR exists(headings, h -> coalesce(schema_of_variant(h) <> 'STRING', true))) THEN 'BAD_HEADING_PATH'
            WHEN NOT {_positive("m['start_line']")} THEN 'BAD_START_LINE' WHEN NOT {_positive("m['end_line']")} THEN 'BAD_END_LINE' WHEN CAST(m['end_line'] AS BIGINT) < CAST(m['start_line'] AS BIGINT) THEN 'LINES_REVERSED' ELSE 'OK' END
        WHEN kind = 'pdf' THEN CASE WHEN coalesce(size(pages), 0) <> 1 THEN 'NOT_ONE_PAGE' WHEN NOT {_positive('pages[0]')} THEN 'BAD_PAGE' ELSE 'OK' END ELSE 'UNSUPPORTED_TYPE' END AS reason FROM member)
    SELECT locator_id, reason, CASE WHEN reason = 'OK' THEN kind END AS source_type, CASE WHEN reason = 'OK' THEN parser END AS parser_version, CASE WHEN reason = 'OK' AND kind = 'markdown' THEN array_join(transform(coalesce(headings, array()), h -> CAST(h AS STRING)), ' / ') END AS heading_path,
        CASE WHEN reason = 'OK' AND kind = 'markdown' THEN CAST(m['start_line'] AS BIGINT) END AS start_line, CASE WHEN reason = 'OK' AND kind = 'markdown' THEN CAST(m['end_line'] AS BIGINT) END AS end_line, CASE WHEN reason = 'OK' AND kind = 'pdf' THEN CAST(pages[0] AS BIGINT) END AS page FROM judged"""


def typed_locators(spark: SparkSession, locators: DataFrame) -> DataFrame:
    """What an evaluation takes of locators (locator_id, json): lines of markdown or one page of a PDF, or the reason why not.

    The first reason that holds; web and DOCX locators are whole locators, but no evaluation places them (UNSUPPORTED_TYPE)."""
    return apply(spark, lambda _: TYPED, {"locator_json": locators.select("locator_id", "json")})


DERIVED["locator_json"] = lambda d: """SELECT chunk_id AS locator_id, CASE (chunk_index + version_id) % 16
    WHEN 0 THEN '{"source_type": "markdown", "parser_version": "p1"' WHEN 1 THEN '[1]' WHEN 2 THEN concat('{"source_type": "markdown", "start_line": ', CAST(line_no AS STRING), ', "end_line": ', CAST(line_no AS STRING), '}')
    WHEN 3 THEN concat('{"source_type": "markdown", "parser_version": "p1", "heading_path": ["A", 3], "start_line": ', CAST(line_no AS STRING), ', "end_line": ', CAST(line_no AS STRING), '}') WHEN 4 THEN '{"source_type": "markdown", "parser_version": "p1", "start_line": 0, "end_line": 3}'
    WHEN 5 THEN '{"source_type": "markdown", "parser_version": "p1", "start_line": 1, "end_line": "3"}' WHEN 6 THEN concat('{"source_type": "markdown", "parser_version": "p1", "start_line": ', CAST(line_no + 1 AS STRING), ', "end_line": ', CAST(line_no AS STRING), '}')
    WHEN 7 THEN '{"source_type": "pdf", "parser_version": "p2", "pages": [1, 2]}' WHEN 8 THEN '{"source_type": "pdf", "parser_version": "p2", "pages": [0]}' WHEN 9 THEN '{"source_type": "pdf", "parser_version": "p2", "page": 3}' WHEN 10 THEN '{"source_type": "web", "parser_version": "p4", "source_url": "https://x.example/"}'
    WHEN 11 THEN '{"parser_version": "", "source_type": "pdf", "pages": [1]}' WHEN 12 THEN concat('{"source_type": "pdf", "parser_version": "p2", "pages": [', CAST(line_no AS STRING), ']}')
    ELSE concat('{"source_type": "markdown", "parser_version": "p1", "heading_path": ["A", "B ', CAST(version_id AS STRING), '"], "start_line": ', CAST(line_no AS STRING), ', "end_line": ', CAST(line_no + 2 AS STRING), '}') END AS json FROM @chunk"""
DERIVED["source_document"] = lambda d: f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'web' END AS source_type, concat('parser-', CAST(doc_id % 4 AS STRING)) AS parser_version, {d.sha("text")} AS source_sha256,
    concat('https://x.example/', CAST(doc_id AS STRING)) AS source_url, concat('https://x.example/final/', CAST(doc_id AS STRING)) AS final_url, '2026-09-29T12:00:00+00:00' AS fetched_at FROM @documents"""


def source_blocks(tables: Tables) -> DataFrame:
    """Blocks of documents of all four kinds: a page is three lines of a PDF's text, every fifth block of a DOCX is a table row of one cell."""
    blocks = markdown_blocks(tables["markdown_text"]).join(tables["source_document"].select("doc_id", "source_type"), "doc_id")
    page = F.when(F.col("source_type") == "pdf", F.floor((F.col("start_line") - 1) / 3) + 1).cast("long")
    row = F.col("ordinal") % 5 == 4
    cell = F.array(F.struct(F.lit(0).cast("long").alias("grid_column"), F.lit(1).cast("long").alias("grid_span"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end")))
    return blocks.withColumns({"page": page, "paragraph_index": F.when(~row, F.col("ordinal")), "table_index": F.when(row, F.floor(F.col("ordinal") / 5)).cast("long"), "row_index": F.when(row, F.lit(0)).cast("long"), "cells": F.when(row, cell).otherwise(F.array())})


def packed_locators(tables: Tables) -> DataFrame:
    # two branches read the blocks, and making them is most of the work
    blocks = kept(source_blocks(tables))
    chunks = heading_pack_chunks(blocks.select("doc_id", "ordinal", F.col("heading_path").alias("heading"), "page", "text"))
    return chunk_locators(chunks, blocks, tables["source_document"])


QUERIES = {
    "chunk_locator": lambda spark, sf_dir: packed_locators(Tables(spark, sf_dir)).select("doc_id", "chunk_index", F.col("locator.source_type").alias("source_type"), F.col("locator.start_line").alias("start_line"), F.col("locator.end_line").alias("end_line"), locator_json("locator").alias("locator")),
    "typed_locator": lambda spark, sf_dir: typed_locators(spark, Tables(spark, sf_dir)["locator_json"]),
}
#: The plain reading by paths. Packing is an ordered fold, so chunk_locator has no SQL; tests hold it against its blocks.
ORACLES = {
    "typed_locator": oracle(
        lambda _: """WITH t AS (SELECT locator_id, CASE WHEN json_valid(json) THEN json END AS j FROM @locator_json), k AS (SELECT *, json_type(j) AS top, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.source_type') = 'VARCHAR' THEN json_extract_string(j, '$.source_type') END AS kind, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.parser_version') = 'VARCHAR' THEN json_extract_string(j, '$.parser_version') END AS parser FROM t),
        r AS (SELECT *, CASE WHEN j IS NULL THEN 'NO_JSON' WHEN top <> 'OBJECT' THEN 'NO_OBJECT' WHEN coalesce(parser, '') = '' THEN 'BAD_PARSER_VERSION' WHEN kind = 'markdown' AND json_exists(j, '$.heading_path') AND (json_type(j, '$.heading_path') <> 'ARRAY' OR len(list_filter(json_extract(j, '$.heading_path[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0) THEN 'BAD_HEADING_PATH'
            WHEN kind = 'markdown' AND NOT coalesce(json_type(j, '$.start_line') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(j, '$.start_line') AS BIGINT) > 0, false) THEN 'BAD_START_LINE' WHEN kind = 'markdown' AND NOT coalesce(json_type(j, '$.end_line') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(j, '$.end_line') AS BIGINT) > 0, false) THEN 'BAD_END_LINE'
            WHEN kind = 'markdown' AND CAST(json_extract_string(j, '$.end_line') AS BIGINT) < CAST(json_extract_string(j, '$.start_line') AS BIGINT) THEN 'LINES_REVERSED' WHEN kind = 'pdf' AND coalesce(json_array_length(j, '$.pages'), 0) <> 1 THEN 'NOT_ONE_PAGE' WHEN kind = 'pdf' AND NOT coalesce(json_type(j, '$.pages[0]') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(j, '$.pages[0]') AS BIGINT) > 0, false) THEN 'BAD_PAGE'
            WHEN kind IN ('markdown', 'pdf') THEN 'OK' ELSE 'UNSUPPORTED_TYPE' END AS reason FROM k)
        SELECT locator_id, reason, CASE WHEN reason = 'OK' THEN kind END AS source_type, CASE WHEN reason = 'OK' THEN parser END AS parser_version, CASE WHEN reason = 'OK' AND kind = 'markdown' THEN array_to_string(coalesce(json_extract_string(j, '$.heading_path[*]'), []), ' / ') END AS heading_path,
            CASE WHEN reason = 'OK' AND kind = 'markdown' THEN CAST(json_extract_string(j, '$.start_line') AS BIGINT) END AS start_line, CASE WHEN reason = 'OK' AND kind = 'markdown' THEN CAST(json_extract_string(j, '$.end_line') AS BIGINT) END AS end_line, CASE WHEN reason = 'OK' AND kind = 'pdf' THEN CAST(json_extract_string(j, '$.pages[0]') AS BIGINT) END AS page FROM r"""
    ),
}
