"""Locators of the four kinds, from packed chunks to JSON and back."""

import json

import pytest
from pyspark.sql import functions as F

from veridex.operators import locators
from veridex.operators.blocks import markdown_blocks
from veridex.operators.chunking import heading_pack_chunks
from veridex.plans.run import Tables

TEXT = "# H\n\none\n\ntwo\n\n" + "word " * 700 + "\n\n## K\n\nthree\n\nfour"
KINDS = ("markdown", "pdf", "docx", "web")


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame([(k, TEXT) for k in range(4)], "doc_id long, text string")
    sources = spark.createDataFrame([(k, kind, f"p{k}", "sha", "https://a.example", "https://b.example", None) for k, kind in enumerate(KINDS)], "doc_id long, source_type string, parser_version string, source_sha256 string, source_url string, final_url string, fetched_at string")
    cell = F.array(F.struct(F.lit(2).cast("long").alias("grid_column"), F.lit(1).cast("long").alias("grid_span"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end")))
    page = F.when(F.col("doc_id") == 1, F.when(F.col("start_line") > 5, 2).otherwise(1)).cast("long")
    blocks = markdown_blocks(docs).withColumns({"page": page, "paragraph_index": F.col("ordinal"), "table_index": F.lit(None).cast("long"), "row_index": F.lit(None).cast("long"), "cells": cell})
    chunks = heading_pack_chunks(blocks.select("doc_id", "ordinal", F.col("heading_path").alias("heading"), "page", "text"))
    out = locators.chunk_locators(chunks, blocks, sources)
    return out, {(r.doc_id, r.ordinal): r for r in blocks.collect()}, {(r.doc_id, r.chunk_index): r for r in chunks.collect()}


def test_segments_lead_back_to_the_text(made):
    out, blocks, chunks = made
    rows = {(r.doc_id, r.chunk_index): r.locator for r in out.collect()}
    assert rows.keys() == chunks.keys()
    for (doc, k), where in rows.items():
        pieces = [blocks[doc, s.block_ordinal].text[s.block_char_start : s.block_char_end] for s in where.segments]
        assert "\n\n".join(pieces) == chunks[doc, k].text
        assert where.block_ordinals == sorted({s.block_ordinal for s in where.segments})
        spanned = [blocks[doc, o] for o in where.block_ordinals]
        assert (where.locator_version, where.source_type, where.parser_version) == (doc + 1, KINDS[doc], f"p{doc}")
        lines = (min(b.start_line for b in spanned), max(b.end_line for b in spanned)) if doc == 0 else (None, None)
        assert (where.start_line, where.end_line) == lines
        assert where.pages == ([spanned[0].page] if doc == 1 else None)
        assert where.source_url == ("https://a.example" if doc == 3 else None)
        assert all((s.page is not None) == (doc == 1) and (s.cells is not None) == (doc == 2) for s in where.segments)
    assert len([1 for doc, _ in rows if doc == 0]) == 4  # one and two, two windows of the long block, three and four


def test_blocks_are_made_once(spark):
    plan = locators.packed_locators(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # packing; texts are parsed before


def test_json_and_back(made):
    out, _, _ = made
    both = out.select("doc_id", "locator", locators.locator_json("locator").alias("json")).withColumn("again", locators.read_locator("json"))
    for r in both.collect():
        assert r.again == r.locator
        members = json.loads(r.json)
        assert ("start_line" in members, "pages" in members, "final_url" in members) == (r.doc_id == 0, r.doc_id == 1, r.doc_id == 3)
        assert None not in members.values()


CASES = [
    ({}, "OK"), ({"heading_path": ["A"]}, "OK"), ({"heading_path": ["A", 1]}, "BAD_HEADING_PATH"), ({"heading_path": "A"}, "BAD_HEADING_PATH"), ({"start_line": 0}, "BAD_START_LINE"), ({"start_line": "1"}, "BAD_START_LINE"), ({"start_line": True}, "BAD_START_LINE"), ({"end_line": None}, "BAD_END_LINE"),
    ({"end_line": 1.5}, "BAD_END_LINE"), ({"start_line": 9}, "LINES_REVERSED"), ({"parser_version": ""}, "BAD_PARSER_VERSION"), ({"parser_version": 1}, "BAD_PARSER_VERSION"), ({"source_type": "web"}, "UNSUPPORTED_TYPE"), ({"source_type": "docx"}, "UNSUPPORTED_TYPE"), ({"source_type": None}, "UNSUPPORTED_TYPE"),
    ({"source_type": "pdf", "pages": [2]}, "OK"), ({"source_type": "pdf", "pages": [1, 2]}, "NOT_ONE_PAGE"), ({"source_type": "pdf", "pages": []}, "NOT_ONE_PAGE"), ({"source_type": "pdf"}, "NOT_ONE_PAGE"), ({"source_type": "pdf", "pages": [0]}, "BAD_PAGE"), ({"source_type": "pdf", "pages": ["1"]}, "BAD_PAGE"),
]


def test_reasons(spark):
    base = {"source_type": "markdown", "parser_version": "p", "start_line": 2, "end_line": 3}
    rows = [(k, json.dumps(base | change)) for k, (change, _) in enumerate(CASES)] + [(100, "no"), (101, "[]"), (102, None)]
    got = {r.locator_id: r for r in locators.typed_locators(spark, spark.createDataFrame(rows, "locator_id long, json string")).collect()}
    assert [got[k].reason for k in range(len(CASES))] == [reason for _, reason in CASES]
    assert [got[k].reason for k in (100, 101, 102)] == ["NO_JSON", "NO_OBJECT", "NO_JSON"]
    assert (got[1].heading_path, got[1].start_line, got[1].end_line, got[1].page) == ("A", 2, 3, None)
    assert (got[15].page, got[15].start_line, got[2].start_line) == (2, None, None)
