"""Content, publishing, idempotent replay, jobs and integrity reports."""

from __future__ import annotations

AS_OF = "DATE '1996-06-30'"

#: What each row of a ledger of model calls must hold; a null leaves a rule open, as constraints of tables do.
USAGE_RULES = {
    "status": "status IN ('SUCCEEDED', 'FAILED', 'TIMEOUT')",
    "usage_source": "usage_source IN ('PROVIDER_REPORTED', 'UNKNOWN')",
    "attempt": "attempt >= 1",
    "prompt_tokens": "prompt_tokens >= 0",
    "completion_tokens": "completion_tokens >= 0",
    "hit_tokens": "hit_tokens >= 0",
    "miss_tokens": "miss_tokens >= 0",
    "latency_ms": "latency_ms >= 0",
    "cost_amount": "cost_amount >= 0",
    "succeeded_without_usage": "status <> 'SUCCEEDED' OR (usage_source = 'PROVIDER_REPORTED' AND prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL)",
    "failure_without_code": "status = 'SUCCEEDED' OR error_code IS NOT NULL",
    "price_parts": "(price_source IS NULL) = (price_currency IS NULL) AND (price_source IS NULL) = (cost_amount IS NULL)",
}

OPERATORS = {
    "content_addressed_versions": lambda d: "SELECT x.kb_id, v.file_hash, concat(CAST(x.kb_id AS STRING), '/', v.file_hash) AS file_ref, count(*) AS refs, min(v.version_id) AS first_version FROM @document_version v JOIN @document x ON x.document_id = v.document_id GROUP BY x.kb_id, v.file_hash",
    "upload_validation": lambda d: f"""SELECT upload_id, CASE WHEN {d.octets('content')} = 0 THEN 'EMPTY' WHEN {d.octets('content')} > 20000000 THEN 'TOO_LARGE' WHEN {d.matches('content', d.escaped("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"))} THEN 'CONTROL_CHARACTER'
        WHEN title = '' OR length(title) > 500 THEN 'TITLE' WHEN NOT {d.matches("filename", "[.](md|markdown|pdf|docx)$")} THEN 'EXTENSION' ELSE 'OK' END AS reason
        FROM (SELECT upload_id, content, {d.replaced("title", d.escaped("^\\s+|\\s+$"), "")} AS title, lower(trim({d.first_match("translate(filename, chr(92), '/')", "([^/]*)$", 1)})) AS filename FROM @upload) u""",
    "web_url_normalize": lambda d: f"""WITH p AS (SELECT page_id, url, lower({d.first_match("url", "^([A-Za-z]+)://", 1)}) AS scheme, {d.first_match("url", "^[A-Za-z]+://([^/?#]*)", 1)} AS authority, {d.first_match("url", "^[A-Za-z]+://[^/?#]*([^#]*)", 1)} AS rest FROM @page_url)
        SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') OR contains(authority, '@') OR contains(url, '#') OR authority = '' OR {d.first_match("authority", ":([0-9]*)$", 1)} NOT IN ('', CASE WHEN scheme = 'http' THEN '80' ELSE '443' END) THEN 'URL_INVALID'
        ELSE concat(scheme, '://', lower({d.replaced("authority", ":[0-9]*$", "")}), CASE WHEN rest = '' THEN '/' WHEN substr(rest, 1, 1) = '?' THEN concat('/', rest) ELSE rest END) END AS final_url FROM p""",
    "docker_size_parse": lambda d: f"""WITH p AS (SELECT event_id, try_cast({d.first_match("size", "^([0-9]+([.][0-9]+)?)[A-Za-z]+$", 1)} AS DECIMAL(12, 2)) AS n, {d.first_match("size", "([A-Za-z]+)$", 1)} AS unit FROM @memory_report)
        SELECT event_id, CAST(floor(n * CASE unit WHEN 'B' THEN 1 WHEN 'kB' THEN 1000 WHEN 'MB' THEN 1000000 WHEN 'GB' THEN 1000000000 WHEN 'KiB' THEN 1024 WHEN 'MiB' THEN 1048576 WHEN 'GiB' THEN 1073741824 END) AS BIGINT) AS bytes FROM p""",
    "document_list": lambda d: "SELECT m.user_id, x.document_id, x.title, CAST(row_number() OVER (PARTITION BY m.user_id ORDER BY x.active_version_id DESC, x.document_id DESC) AS BIGINT) AS place FROM @document x JOIN @kb_member m ON m.kb_id = x.kb_id AND NOT m.revoked WHERE NOT x.deleted AND (x.acl_mode = 'INHERIT' OR EXISTS (SELECT 1 FROM @document_acl a WHERE a.document_id = x.document_id AND a.user_id = m.user_id))",
    "document_view": lambda d: """WITH latest AS (SELECT document_id, max_by(version_id, version_no) AS latest_version, max(version_no) AS version_no FROM @document_version GROUP BY document_id), job AS (SELECT version_id, max(job_id) AS job_id FROM @ingest_job GROUP BY version_id)
        SELECT x.document_id, x.active_version_id, a.status AS active_status, l.latest_version, l.version_no, j.job_id FROM @document x LEFT JOIN @document_version a ON a.version_id = x.active_version_id LEFT JOIN latest l ON l.document_id = x.document_id LEFT JOIN job j ON j.version_id = l.latest_version""",
    "document_content_target": lambda d: "SELECT q.user_id, q.document_id, v.version_id, v.file_hash FROM (SELECT m.user_id, x.document_id, x.acl_mode, coalesce(r.pinned_version, x.active_version_id) AS target FROM @content_request r JOIN @document x ON x.document_id = r.document_id JOIN @kb_member m ON m.kb_id = x.kb_id AND m.user_id = r.user_id AND NOT m.revoked WHERE NOT x.deleted) q JOIN @document_version v ON v.version_id = q.target AND v.document_id = q.document_id WHERE q.acl_mode = 'INHERIT' OR EXISTS (SELECT 1 FROM @document_acl a WHERE a.document_id = q.document_id AND a.user_id = q.user_id)",
    "idempotent_upload_replay": lambda d: f"""SELECT version_id, {d.sha("raw_key")} AS dedupe_key, first_version, CASE WHEN version_id = first_version THEN 'CREATED' WHEN first_deleted THEN 'DELETED' WHEN identity = first_identity THEN 'REUSED' ELSE 'CONFLICT' END AS verdict FROM (
        SELECT *, first_value(version_id) OVER w AS first_version, first_value(deleted) OVER w AS first_deleted, first_value(identity) OVER w AS first_identity FROM (SELECT *, CASE WHEN web THEN concat(url, title) ELSE concat(file_hash, title) END AS identity FROM @upload_request u) i WINDOW w AS (PARTITION BY raw_key ORDER BY version_id)) q""",
    "version_replay": lambda d: f"""SELECT version_id, concat(prefix, ':', CAST(expected_version AS STRING)) AS key, CASE WHEN version_id = first_version THEN 'CREATED' WHEN expected_version = first_expected AND file_hash = first_hash AND title = first_title THEN 'REUSED' ELSE 'CONFLICT' END AS verdict
        FROM (SELECT *, first_value(version_id) OVER w AS first_version, first_value(expected_version) OVER w AS first_expected, first_value(file_hash) OVER w AS first_hash, first_value(title) OVER w AS first_title FROM (
        SELECT version_id, file_hash, title, expected_version, concat('ver1:', CAST(document_id AS STRING), ':', {d.sha("concat(CAST(organization_id AS STRING), ':', CAST(kb_id AS STRING), ':', CAST(document_id AS STRING), ':', version_key)")}) AS prefix FROM @upload_request u) i WINDOW w AS (PARTITION BY prefix ORDER BY version_id)) q""",
    "version_key_parse": lambda d: f"""WITH p AS (SELECT version_id, key, {d.matches("key", "^ver1:[0-9]+:[0-9a-f]{64}:[0-9]+$")} AS ok FROM @version_key)
        SELECT version_id, CASE WHEN ok THEN CAST({d.first_match("key", "^ver1:([0-9]+):", 1)} AS BIGINT) END AS document_id, CASE WHEN ok THEN CAST({d.first_match("key", ":([0-9]+)$", 1)} AS BIGINT) END AS expected_version FROM p""",
    "publish_cas": lambda d: d.plan(
        lambda _: f"""WITH a AS (SELECT *, CASE WHEN lease_lost OR lease_token IS NULL THEN 'LEASE_LOST' WHEN deleted OR version_status <> 'READY' THEN 'OUT_OF_SCOPE' WHEN expected IS NULL OR expected <> active_version_id THEN 'CONFLICT' ELSE 'CANDIDATE' END AS first_verdict FROM @publish_attempt t),
        r AS (SELECT *, row_number() OVER (PARTITION BY document_id, expected, first_verdict ORDER BY job_id) AS place FROM a), v AS (SELECT job_id, document_id, version_id, active_version_id, CASE WHEN first_verdict = 'CANDIDATE' THEN CASE WHEN place = 1 THEN 'PUBLISHED' ELSE 'CONFLICT' END ELSE first_verdict END AS verdict FROM r)
        SELECT job_id, document_id, version_id, verdict, CASE WHEN verdict = 'PUBLISHED' THEN version_id ELSE active_version_id END AS new_pointer FROM v""",
        lambda _: f"""WITH a AS MATERIALIZED (SELECT *, NOT lease_lost AND lease_token IS NOT NULL AS held, NOT deleted AND version_status = 'READY' AS fit, coalesce(expected = active_version_id, false) AS current FROM @publish_attempt t),
        w AS (SELECT *, held AND fit AND current AND NOT EXISTS (SELECT 1 FROM a o WHERE o.held AND o.fit AND o.current AND o.document_id = a.document_id AND o.job_id < a.job_id) AS won FROM a)
        SELECT job_id, document_id, version_id, CASE WHEN won THEN 'PUBLISHED' WHEN NOT held THEN 'LEASE_LOST' WHEN NOT fit THEN 'OUT_OF_SCOPE' ELSE 'CONFLICT' END AS verdict, CASE WHEN won THEN version_id ELSE active_version_id END AS new_pointer FROM w""",
    ),
    "generation_completeness": lambda d: "WITH c AS (SELECT generation_id, count(*) AS chunks FROM @chunk GROUP BY generation_id), e AS (SELECT c.generation_id, e.profile_id, count(*) AS embeddings FROM @stored_embedding e JOIN @chunk c ON c.chunk_id = e.chunk_id GROUP BY c.generation_id, e.profile_id) SELECT g.generation_id, g.expected_chunks, coalesce(c.chunks, 0) AS chunks, coalesce(e.embeddings, 0) AS embeddings, coalesce(c.chunks, 0) = coalesce(e.embeddings, 0) AND coalesce(c.chunks, 0) = g.expected_chunks AS complete FROM @planned_generation g LEFT JOIN c ON c.generation_id = g.generation_id LEFT JOIN e ON e.generation_id = g.generation_id AND e.profile_id = g.profile_id",
    "ready_uniqueness": lambda d: "SELECT version_id, profile_id, count(*) AS ready FROM @index_generation WHERE status = 'READY' GROUP BY version_id, profile_id HAVING count(*) > 1",
    "soft_delete": lambda d: """WITH wanted AS (SELECT DISTINCT document_id FROM @delete_request), kb AS (SELECT x.kb_id, count(*) AS n FROM @document x JOIN wanted w ON w.document_id = x.document_id WHERE NOT x.deleted GROUP BY x.kb_id)
        SELECT x.document_id, x.deleted OR w.document_id IS NOT NULL AS deleted, CASE WHEN w.document_id IS NULL THEN 'UNTOUCHED' WHEN x.deleted THEN 'NO_OP' ELSE 'DELETED' END AS outcome, k.kb_revision + coalesce(b.n, 0) AS kb_revision, coalesce(j.cancelled, 0) AS cancelled_jobs
        FROM @document x LEFT JOIN wanted w ON w.document_id = x.document_id JOIN @knowledge_base k ON k.kb_id = x.kb_id LEFT JOIN kb b ON b.kb_id = x.kb_id LEFT JOIN (SELECT v.document_id, count(*) AS cancelled FROM @ingest_job j JOIN @document_version v ON v.version_id = j.version_id JOIN wanted w ON w.document_id = v.document_id WHERE j.status IN ('QUEUED', 'PARSING', 'CHUNKING', 'EMBEDDING') GROUP BY v.document_id) j ON j.document_id = x.document_id AND NOT x.deleted""",
    "claim_decision": lambda d: f"""SELECT j.job_id, CASE WHEN v.version_id IS NULL THEN 'MISSING' WHEN j.status IN ('READY', 'FAILED', 'CANCELLED') THEN 'TERMINAL' WHEN x.deleted THEN 'DOCUMENT_DELETED' WHEN v.status = 'FAILED' THEN 'VERSION_FAILED' WHEN v.status = 'NEEDS_OCR' THEN 'NEEDS_OCR'
        WHEN j.next_run_at > {AS_OF} THEN 'NOT_DUE' WHEN j.lease_until > {AS_OF} THEN 'LEASED' WHEN j.attempt >= 3 THEN 'EXHAUSTED' WHEN j.status = 'QUEUED' THEN 'CLAIM' ELSE 'RECLAIM' END AS decision FROM @ingest_job j LEFT JOIN @document_version v ON v.version_id = j.version_id LEFT JOIN @document x ON x.document_id = v.document_id""",
    "profile_hash": lambda d: f"SELECT profile_id, {d.sha('text')} AS config_hash FROM (SELECT profile_id, concat('{{\"analyzer\":\"', analyzer, '\",\"dimension\":', CAST(dimension AS STRING), ',\"normalized\":', CASE WHEN normalized THEN 'true' ELSE 'false' END, ',\"revision\":', CAST(revision AS STRING), ',\"schema\":1}}') AS text FROM @index_profile) p",
    "profile_identity": lambda d: f"""SELECT generation_id, CASE WHEN job_profile_id IS NULL THEN 'UNBOUND' WHEN profile_id IS NULL THEN 'MISSING' WHEN profile_id <> job_profile_id THEN 'ID_MISMATCH' WHEN source_type NOT IN ('markdown', 'pdf', 'docx', 'web') THEN 'SOURCE_MISMATCH' WHEN parser_version <> 'blocks-v1' THEN 'PARSER_MISMATCH'
        WHEN NOT coalesce(dimension > 0 AND normalized AND analyzer <> '' AND revision >= 1, false) THEN 'CONTRACT_MISMATCH' WHEN config_hash <> {d.sha("concat_ws('/', analyzer, CAST(normalized AS STRING), CAST(dimension AS STRING), CAST(revision AS STRING))")} THEN 'HASH_MISMATCH' WHEN analyzer <> 'words-v2' OR dimension <> 64 OR revision <> 7 THEN 'CONTRACT_MISMATCH' ELSE 'ALLOWED' END AS outcome FROM @identity_case""",
    "stalled_jobs": lambda d: f"SELECT j.job_id, CASE WHEN j.attempt < 3 THEN 'REQUEUE' ELSE 'EXHAUSTED' END AS action, CASE WHEN j.attempt < 3 THEN CAST(least(5 * power(2, greatest(j.attempt - 1, 0)), 300) AS BIGINT) END AS backoff_seconds FROM @ingest_job j JOIN @document_version v ON v.version_id = j.version_id JOIN @document x ON x.document_id = v.document_id WHERE j.status IN ('PARSING', 'CHUNKING', 'EMBEDDING') AND j.lease_until < {AS_OF} AND j.error_code IS NULL AND NOT x.deleted",
    "undelivered_jobs": lambda d: f"SELECT job_id, sent, CASE WHEN sent >= 5 THEN 'UNCONFIRMED' ELSE 'FOLLOW_UP' END AS action FROM (SELECT j.job_id, count(*) AS sent, max(o.sent_at) AS last_sent FROM @ingest_job j JOIN @outbox_event o ON o.job_id = j.job_id AND o.status = 'SENT' WHERE j.status = 'QUEUED' AND j.next_run_at <= {AS_OF} AND j.lease_owner IS NULL AND NOT EXISTS (SELECT 1 FROM @outbox_event p WHERE p.job_id = j.job_id AND p.status = 'PENDING') GROUP BY j.job_id) q WHERE last_sent < {AS_OF}",
    "integrity_facts": lambda d: """SELECT 'ready_versions' AS fact, count(*) AS n FROM @document_version WHERE status = 'READY' UNION ALL SELECT 'ready_generations', count(*) FROM @index_generation WHERE status = 'READY' UNION ALL SELECT 'chunks', count(*) FROM @chunk UNION ALL SELECT 'embeddings', count(*) FROM @chunk_embedding
        UNION ALL SELECT 'dangling_pointers', count(*) FROM @document x WHERE NOT EXISTS (SELECT 1 FROM @document_version v WHERE v.version_id = x.active_version_id AND v.status = 'READY') UNION ALL SELECT 'jobs_without_generation', count(*) FROM @ingest_job j WHERE NOT EXISTS (SELECT 1 FROM @index_generation g WHERE g.version_id = j.version_id)""",
    "blob_manifest_diff": lambda d: """WITH manifest AS (SELECT ref, min(size) AS size, count(*) AS uses FROM @blob_manifest GROUP BY ref)
        SELECT coalesce(m.ref, f.ref) AS ref, CASE WHEN f.ref IS NULL THEN 'MISSING' WHEN m.ref IS NULL THEN 'NOT_IN_MANIFEST' WHEN m.size <> f.size THEN 'SIZE_DIFFERS' WHEN f.hash <> m.ref THEN 'HASH_DIFFERS' WHEN m.uses > 1 THEN 'DUPLICATE_REFERENCE' ELSE 'OK' END AS finding FROM manifest m FULL OUTER JOIN @blob_found f ON m.ref = f.ref""",
    "lease_consistency": lambda d: "SELECT job_id FROM @ingest_job WHERE NOT (lease_owner IS NULL AND lease_token IS NULL AND lease_until IS NULL) AND NOT (lease_owner IS NOT NULL AND lease_token IS NOT NULL AND lease_until IS NOT NULL)",
    "usage_constraints": lambda d: d.plan(
        lambda _: f"SELECT usage_id, concat_ws(',', {', '.join(f'CASE WHEN NOT ({rule}) THEN {name!r} END' for name, rule in USAGE_RULES.items())}) AS broken FROM @usage_row WHERE NOT ({' AND '.join(f'coalesce({rule}, true)' for rule in USAGE_RULES.values())})",
        lambda _: """SELECT usage_id, string_agg(name, ',' ORDER BY place) AS broken FROM (
            SELECT usage_id, 1 AS place, 'status' AS name FROM @usage_row WHERE status <> 'SUCCEEDED' AND status <> 'FAILED' AND status <> 'TIMEOUT' UNION ALL SELECT usage_id, 2, 'usage_source' FROM @usage_row WHERE usage_source <> 'PROVIDER_REPORTED' AND usage_source <> 'UNKNOWN' UNION ALL SELECT usage_id, 3, 'attempt' FROM @usage_row WHERE attempt < 1
            UNION ALL SELECT usage_id, 4, 'prompt_tokens' FROM @usage_row WHERE prompt_tokens < 0 UNION ALL SELECT usage_id, 5, 'completion_tokens' FROM @usage_row WHERE completion_tokens < 0 UNION ALL SELECT usage_id, 6, 'hit_tokens' FROM @usage_row WHERE hit_tokens < 0 UNION ALL SELECT usage_id, 7, 'miss_tokens' FROM @usage_row WHERE miss_tokens < 0
            UNION ALL SELECT usage_id, 8, 'latency_ms' FROM @usage_row WHERE latency_ms < 0 UNION ALL SELECT usage_id, 9, 'cost_amount' FROM @usage_row WHERE cost_amount < 0 UNION ALL SELECT usage_id, 10, 'succeeded_without_usage' FROM @usage_row WHERE status = 'SUCCEEDED' AND (usage_source <> 'PROVIDER_REPORTED' OR prompt_tokens IS NULL OR completion_tokens IS NULL)
            UNION ALL SELECT usage_id, 11, 'failure_without_code' FROM @usage_row WHERE status <> 'SUCCEEDED' AND error_code IS NULL UNION ALL SELECT usage_id, 12, 'price_parts' FROM @usage_row WHERE (CASE WHEN price_source IS NULL THEN 0 ELSE 1 END + CASE WHEN price_currency IS NULL THEN 0 ELSE 1 END + CASE WHEN cost_amount IS NULL THEN 0 ELSE 1 END) NOT IN (0, 3)) q GROUP BY usage_id""",
    ),
}
