"""Conversations, citations and answers; content hides once a source loses authorization."""

from __future__ import annotations

from .retrieval import SOURCE_STATE

TURNS = f"""(SELECT conv_id, turn, question, text AS answer FROM (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS question FROM @conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) q WHERE role = 'assistant' AND before = 'user')"""
BLOCKED = f"(SELECT DISTINCT conv_id, turn FROM ({SOURCE_STATE}) s WHERE NOT is_authorized)"


OPERATORS = {
    "conversation_list": lambda d: "SELECT owner, conv_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY pinned DESC, last_turn DESC, conv_id DESC) AS BIGINT) AS place FROM (SELECT conv_id % 20 AS owner, conv_id, conv_id % 7 = 0 AS pinned, max(turn) AS last_turn FROM @conversations WHERE conv_id % 13 <> 4 GROUP BY conv_id) q",
    "conversation_title": lambda d: f"SELECT conv_id, substr(trim({d.replaced('line', '[ ' + chr(9) + ']+', ' ')}), 1, 200) AS title FROM (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) AS first_line FROM {d.each('''(SELECT conv_id, turn, text FROM @conversations WHERE role = 'user')''', d.lines('text'), 'place', 'line')} q WHERE trim(line) <> '') r WHERE first_line = 1 AND conv_id % 3 <> 0",
    "next_sequence": lambda d: "SELECT n.conv_id, n.turn, coalesce(m.top, 0) + CAST(row_number() OVER (PARTITION BY n.conv_id ORDER BY n.turn) AS BIGINT) AS sequence FROM (SELECT conv_id, turn FROM @conversations WHERE turn % 3 = 2) n LEFT JOIN (SELECT conv_id, max(turn) AS top FROM @conversations WHERE turn % 3 <> 2 GROUP BY conv_id) m ON m.conv_id = n.conv_id",
    "history_turns": lambda d: f"SELECT conv_id, turn, question, answer FROM {TURNS} t",
    "history_visibility": lambda d: f"SELECT v.conv_id, v.turn, v.role, b.conv_id IS NULL AS visible, CASE WHEN b.conv_id IS NULL THEN v.text END AS text FROM @conversations v LEFT JOIN {BLOCKED} b ON b.conv_id = v.conv_id AND b.turn = v.turn AND v.role = 'assistant'",
    "history_window": lambda d: f"SELECT conv_id, turn, CASE WHEN blocked THEN 'unauthorized' WHEN place > 3 THEN 'outside_window' ELSE 'eligible' END AS reason FROM (SELECT t.conv_id, t.turn, b.conv_id IS NOT NULL AS blocked, row_number() OVER (PARTITION BY t.conv_id, b.conv_id IS NULL ORDER BY t.turn DESC) AS place FROM {TURNS} t LEFT JOIN {BLOCKED} b ON b.conv_id = t.conv_id AND b.turn = t.turn) q",
    "rewrite_window": lambda d: f"SELECT conv_id, {d.joined('concat(CAST(place AS STRING), chr(46), chr(32), question)', 'place', ' / ')} AS prompt FROM (SELECT conv_id, question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT t.conv_id, t.turn, t.question, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn DESC) AS back FROM {TURNS} t WHERE NOT EXISTS (SELECT 1 FROM {BLOCKED} b WHERE b.conv_id = t.conv_id AND b.turn = t.turn)) q WHERE back <= 3) r GROUP BY conv_id",
    "citation_markers": lambda d: f"SELECT conv_id, turn, place, CAST({d.first_match('m', '[0-9]+')} AS BIGINT) AS number FROM {d.each('''(SELECT conv_id, turn, concat(text, ' [', CAST(turn + 1 AS STRING), '] and [7](x) [12] [3]: [1234]') AS t FROM @conversations WHERE role = 'assistant')''', d.all_matches('translate(t, chr(91) || chr(93), chr(60) || chr(62))', '<[0-9]{1,3}>([^(<:]|$)'), 'place', 'm')} q",
    "citation_draft": lambda d: f"SELECT conv_id, turn, label, chunk_id, substr(line, 1, 500) AS quote, {d.sha('line')} AS quote_hash FROM @citation",
    "citation_view": lambda d: "SELECT c.conv_id, c.turn, c.label, c.chunk_id, x.document_id, v.version_no, coalesce(CASE WHEN x.document_id % 17 <> 2 THEN x.active_version_id END = c.version_id, false) AS is_current_version FROM @citation c JOIN @document_version v ON v.version_id = c.version_id JOIN @document x ON x.document_id = v.document_id",
    "degraded_merge": lambda d: f"SELECT user_id, {d.joined('event_type', 'first_seen')} AS stages FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM @events WHERE event_type IN ('error', 'signup', 'view') GROUP BY user_id, event_type) q GROUP BY user_id",
}
