"""Text to blocks, and blocks to chunks."""

from __future__ import annotations

TOKENS = "(SELECT doc_id, text, CAST({n} AS BIGINT) AS tokens FROM @documents)"


def tokens(d) -> str:
    return d.size(d.all_matches("text", "[A-Za-z0-9]+|[^A-Za-z0-9 ]"))


OPERATORS = {
    "page_blocks": lambda d: d.plan(
        lambda _: f"""WITH filled AS (SELECT doc_id, page, trim(text) AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) - 1 AS ordinal FROM @source_page WHERE trim(text) <> '')
        SELECT x.doc_id, f.ordinal, f.page, {d.sha("f.text")} AS text_sha, CASE WHEN f.doc_id IS NULL THEN 'NEEDS_OCR' ELSE 'OK' END AS status FROM (SELECT DISTINCT doc_id FROM @source_page) x LEFT JOIN filled f ON f.doc_id = x.doc_id""",
        lambda _: """SELECT doc_id, (SELECT count(*) FROM @source_page o WHERE o.doc_id = p.doc_id AND o.page < p.page AND trim(o.text) <> '') AS ordinal, page, sha256(trim(text)) AS text_sha, 'OK' AS status FROM @source_page p WHERE trim(text) <> ''
            UNION ALL SELECT doc_id, NULL, NULL, NULL, 'NEEDS_OCR' FROM @source_page GROUP BY doc_id HAVING max(length(trim(text))) = 0""",
    ),
    "table_row_blocks": lambda d: d.plan(
        lambda _: f"""WITH cell AS (SELECT row_id, col, trim(cell) AS cell FROM @table_cell), bound AS (SELECT *, min(CASE WHEN cell <> '' THEN col END) OVER (PARTITION BY row_id) AS first_col, max(CASE WHEN cell <> '' THEN col END) OVER (PARTITION BY row_id) AS last_col FROM cell),
        span AS (SELECT *, CAST(coalesce(sum(length(cell) + 3) OVER (PARTITION BY row_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM bound WHERE col BETWEEN first_col AND last_col)
        SELECT row_id, {d.joined("cell", "col", " | ")} AS text, {d.joined("concat(CAST(col AS STRING), ':', CAST(char_start AS STRING), '-', CAST(char_start + length(cell) AS STRING))", "col")} AS spans FROM span GROUP BY row_id""",
        lambda _: """WITH row_ AS (SELECT row_id, list(trim(cell) ORDER BY col) AS cells, min(col) AS base FROM @table_cell GROUP BY row_id), cut AS (SELECT row_id, base, cells, list_min(list_filter(range(1, len(cells) + 1), lambda i: cells[i] <> '')) AS a, list_max(list_filter(range(1, len(cells) + 1), lambda i: cells[i] <> '')) AS b FROM row_)
        SELECT row_id, array_to_string(cells[a:b], ' | ') AS text, array_to_string(list_transform(range(a, b + 1), lambda i: concat(base + i - 1, ':', length(array_to_string(cells[a:i], ' | ')) - length(cells[i]), '-', length(array_to_string(cells[a:i], ' | ')))), ',') AS spans FROM cut WHERE a IS NOT NULL""",
    ),
    "token_count": lambda d: f"SELECT doc_id, {tokens(d)} AS tokens FROM @documents",
    "chunk_identity": lambda d: f"SELECT c.chunk_id, c.chunk_index, {d.sha('c.line')} AS text_hash, {d.sha('concat(x.title, chr(10), chr(10), c.line)')} AS model_input_hash FROM @chunk c JOIN @document x ON x.document_id = c.document_id",
    "budget_check": lambda d: "SELECT event_id, target, overlap, most, CASE WHEN target <= 0 OR most <= 0 THEN 'NOT_POSITIVE' WHEN overlap < 0 THEN 'NEGATIVE_OVERLAP' WHEN target > most THEN 'TARGET_OVER_MAX' WHEN overlap >= target THEN 'OVERLAP_OVER_TARGET' ELSE 'OK' END AS verdict FROM @chunk_budget",
}
