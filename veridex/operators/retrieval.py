"""Authorization, keyword and vector paths, and their fusion. Every operator takes a table of requests."""

from __future__ import annotations

from ..plans.fixtures import DERIVED

TOP, FUSED, CONSTANT = 20, 40, 60

#: The authorization chain, used by every path: only it says who may read a chunk.
AUTHORIZED = """SELECT m.user_id, c.chunk_id, c.document_id, c.version_id, c.chunk_index, x.kb_id, c.line, e.embedding
    FROM @chunk c JOIN @index_generation g ON c.generation_id = g.generation_id AND g.status = 'READY'
    JOIN @document_version v ON v.version_id = g.version_id AND v.status = 'READY'
    JOIN @document x ON x.document_id = v.document_id AND x.active_version_id = v.version_id AND NOT x.deleted
    JOIN @knowledge_base k ON k.kb_id = x.kb_id AND k.profile_id = g.profile_id
    JOIN @chunk_embedding e ON e.chunk_id = c.chunk_id AND e.profile_id = k.profile_id
    JOIN @kb_member m ON m.kb_id = k.kb_id AND NOT m.revoked
    JOIN @user_account u ON u.user_id = m.user_id AND u.organization_id = k.organization_id
    WHERE x.acl_mode = 'INHERIT' OR EXISTS (SELECT 1 FROM @document_acl a WHERE a.document_id = x.document_id AND a.user_id = m.user_id)"""

SCOPE = """SELECT q.request_id, CASE WHEN count(*) > count(m.kb_id) THEN 'NOT_ACCESSIBLE' WHEN count(DISTINCT k.profile_id) > 1 THEN 'CONFLICT' WHEN count(k.profile_id) = 0 THEN 'EMPTY'
    WHEN bool_or(k.profile_id IS NOT NULL AND (p.profile_id IS NULL OR p.revision IS NULL OR p.dimension IS NULL OR NOT p.normalized)) THEN 'UNAVAILABLE'
    WHEN max(CASE WHEN k.profile_id IS NOT NULL THEN p.analyzer END) <> 'words-v2' THEN 'ANALYZER_MISMATCH' ELSE 'OK' END AS verdict, count(k.profile_id) AS searchable
    FROM @request_kb q JOIN @knowledge_base k ON k.kb_id = q.kb_id LEFT JOIN @kb_member m ON m.kb_id = q.kb_id AND m.user_id = q.user_id AND NOT m.revoked
    LEFT JOIN @index_profile p ON p.profile_id = k.profile_id GROUP BY q.request_id"""

#: Generations whose chunks can be searched, whoever asks, and what each request of a good scope may ask for; then who may read what of it.
READY_GENERATION = """SELECT g.generation_id, x.document_id, x.kb_id, x.acl_mode, k.profile_id
    FROM @index_generation g JOIN @document_version v ON v.version_id = g.version_id AND v.status = 'READY' AND g.status = 'READY'
    JOIN @document x ON x.document_id = v.document_id AND x.active_version_id = v.version_id AND NOT x.deleted
    JOIN @knowledge_base k ON k.kb_id = x.kb_id AND k.profile_id = g.profile_id"""
ASKED = f"""SELECT q.request_id, q.user_id, q.kb_id FROM @request_kb q JOIN ({SCOPE}) s ON s.request_id = q.request_id AND s.verdict = 'OK'
    JOIN @kb_member m ON m.kb_id = q.kb_id AND m.user_id = q.user_id AND NOT m.revoked
    JOIN @knowledge_base k ON k.kb_id = q.kb_id JOIN @user_account u ON u.user_id = q.user_id AND u.organization_id = k.organization_id"""
MAY_READ = "(r.acl_mode = 'INHERIT' OR EXISTS (SELECT 1 FROM @document_acl a WHERE a.document_id = r.document_id AND a.user_id = q.user_id))"

#: For the check, what a request may read: all that its user may read, in the bases it names.
ELIGIBLE = f"eligible AS (SELECT q.request_id, a.* FROM ({AUTHORIZED}) a JOIN @request_kb q ON q.user_id = a.user_id AND q.kb_id = a.kb_id JOIN ({SCOPE}) s ON s.request_id = q.request_id AND s.verdict = 'OK')"


def occurrences(d) -> str:
    """For the check, by the plain reading: all that a request may read is analysed for it, then terms are counted."""
    return f"""{ELIGIBLE}, wanted AS (SELECT request_id, count(*) AS n FROM @query_term GROUP BY request_id),
    every AS (SELECT e.request_id, e.chunk_id, e.term, e.place FROM {d.each("eligible", d.terms("line"), "place", "term")} e JOIN @query_term t ON t.request_id = e.request_id AND t.term = e.term),
    hit AS (SELECT e.request_id, e.chunk_id FROM every e JOIN wanted w ON w.request_id = e.request_id GROUP BY e.request_id, e.chunk_id, w.n HAVING count(DISTINCT e.term) = w.n),
    occurrence AS (SELECT e.* FROM every e JOIN hit h ON h.request_id = e.request_id AND h.chunk_id = e.chunk_id)"""


#: For the check, a match's score: its covers, shortest stretches with all terms, each with 1 / (1 + its places that match no term).
COVERS = """ends AS (SELECT o.request_id, o.chunk_id, o.place AS stop, p.term, max(p.place) AS place FROM occurrence o JOIN occurrence p ON p.request_id = o.request_id AND p.chunk_id = o.chunk_id AND p.place <= o.place GROUP BY o.request_id, o.chunk_id, o.place, p.term),
    stretch AS (SELECT e.request_id, e.chunk_id, e.stop, min(e.place) AS low FROM ends e JOIN wanted w ON w.request_id = e.request_id GROUP BY e.request_id, e.chunk_id, e.stop, w.n HAVING count(*) = w.n),
    cover AS (SELECT * FROM (SELECT *, coalesce(lag(low) OVER (PARTITION BY request_id, chunk_id ORDER BY stop), -1) AS before FROM stretch) s WHERE low > before),
    filled AS (SELECT c.request_id, c.chunk_id, c.stop, c.low, count(*) AS k FROM cover c JOIN occurrence o ON o.request_id = c.request_id AND o.chunk_id = c.chunk_id AND o.place BETWEEN c.low AND c.stop GROUP BY c.request_id, c.chunk_id, c.stop, c.low)"""

#: Tables that search.py makes in Spark, as the check reads them.
PLAIN = {
    "chunk_terms": lambda d: f"SELECT chunk_id, {d.terms('line')} AS terms FROM @chunk",
    "indexed_chunk": lambda d: "SELECT * FROM @chunk",
    "posting": lambda d: f"SELECT term, chunk_id, count(*) AS tf, {d.joined('CAST(place AS STRING)', 'place')} AS positions FROM {d.each('@chunk', d.terms('line'), 'place', 'term')} q GROUP BY term, chunk_id",
    "keyword_match": lambda d: f"WITH {occurrences(d)} SELECT request_id, chunk_id FROM hit",
    "keyword_score": lambda d: f"WITH {occurrences(d)}, {COVERS} SELECT request_id, chunk_id, count(*) AS covers, round(sum(1.0E0 / (2 + stop - low - k)), 9) AS score FROM filled GROUP BY request_id, chunk_id",
    "canary_found": lambda d: """SELECT DISTINCT y.item_id FROM @canary y JOIN @request_kb q ON q.request_id = y.item_id JOIN @document x ON x.kb_id = q.kb_id AND NOT x.deleted JOIN @chunk c ON c.document_id = x.document_id AND c.version_id = x.active_version_id
        WHERE contains(c.line, y.canary) AND EXISTS (SELECT 1 FROM @kb_member m WHERE m.kb_id = q.kb_id AND m.user_id = q.user_id AND NOT m.revoked) AND (SELECT max(u.organization_id) FROM @user_account u WHERE u.user_id = q.user_id) = (SELECT max(k.organization_id) FROM @knowledge_base k WHERE k.kb_id = q.kb_id)""",
    "vector_top": lambda d: f"""WITH {ELIGIBLE}, near AS (SELECT e.request_id, e.chunk_id, round({d.dot("e.embedding", "r.embedding")}, 6) AS score FROM eligible e JOIN @search_request r ON r.request_id = e.request_id)
        SELECT * FROM (SELECT request_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS BIGINT) AS rank FROM near) k WHERE rank <= {TOP}""",
}
DERIVED.update(PLAIN)
KEYWORD_TOP = f"SELECT * FROM (SELECT request_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS BIGINT) AS rank FROM @keyword_score) k WHERE rank <= {TOP}"


DERIVED["ranked"] = lambda d: f"""WITH keyword_top AS ({KEYWORD_TOP}), fused AS (SELECT coalesce(v.request_id, k.request_id) AS request_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vector_rank, k.rank AS keyword_rank,
    coalesce(1.0E0 / ({CONSTANT} + v.rank), 0.0E0) + coalesce(1.0E0 / ({CONSTANT} + k.rank), 0.0E0) AS score FROM @vector_top v FULL OUTER JOIN keyword_top k ON v.request_id = k.request_id AND v.chunk_id = k.chunk_id)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, chunk_id) AS BIGINT) AS fusion_rank FROM fused) f WHERE fusion_rank <= {FUSED}"""

#: The same, worked out once where several steps read it.
DERIVED["ranked_kept"] = lambda d: "SELECT * FROM @ranked"

RERANKED = 10


def rerank(scores: str) -> str:
    """The top of a request in the order of outside scores, if there is one for each of its members and no other; else nothing moves."""
    return f"""given AS (SELECT request_id AS scored_request, chunk_id AS scored_chunk, max(score) AS outside, count(*) AS k FROM {scores} o GROUP BY request_id, chunk_id),
    scored AS (SELECT r.*, coalesce(r.request_id, g.scored_request) AS of_request, g.outside, g.k FROM @ranked_kept r FULL OUTER JOIN given g ON g.scored_request = r.request_id AND g.scored_chunk = r.chunk_id),
    checked AS (SELECT *, bool_and(CASE WHEN chunk_id IS NULL THEN false WHEN fusion_rank <= {RERANKED} THEN coalesce(k, 0) = 1 AND outside IS NOT NULL ELSE k IS NULL END) OVER (PARTITION BY of_request) AS ok FROM scored),
    reranked AS (SELECT *, NOT ok AS rerank_unavailable, CASE WHEN ok AND fusion_rank <= {RERANKED} THEN CAST(row_number() OVER (PARTITION BY of_request, fusion_rank <= {RERANKED} ORDER BY outside DESC, chunk_id) AS BIGINT) ELSE fusion_rank END AS final_rank FROM checked WHERE chunk_id IS NOT NULL)"""


#: Stands for a model's scores of the fused top, of which some are missing, doubled or foreign.
SCORES = f"""(SELECT r.request_id, r.chunk_id, (r.chunk_id * 7919) % 101 AS score FROM @ranked_kept r JOIN @nation t ON t.n_nationkey < 2
    WHERE t.n_nationkey = 0 AND r.fusion_rank <= {RERANKED} AND NOT (r.request_id % 6 = 0 AND r.fusion_rank = 3) OR t.n_nationkey = 1 AND r.request_id % 7 = 0 AND r.fusion_rank IN (2, {RERANKED + 1}))"""

CITED = "(SELECT DISTINCT user_id, conv_id, turn, chunk_id, version_id, document_id FROM @citation)"

SOURCE_STATE = f"""SELECT c.user_id, c.conv_id, c.turn, c.chunk_id, m.user_id IS NOT NULL AND NOT coalesce(m.revoked, true) AS member_active, coalesce(u.organization_id = k.organization_id, false) AS in_organization, x.deleted,
    x.acl_mode = 'INHERIT' OR a.user_id IS NOT NULL AS acl_allowed, x.active_version_id = c.version_id AS is_current,
    m.user_id IS NOT NULL AND NOT coalesce(m.revoked, true) AND coalesce(u.organization_id = k.organization_id, false) AND NOT x.deleted AND (x.acl_mode = 'INHERIT' OR a.user_id IS NOT NULL) AS is_authorized
    FROM {CITED} c JOIN @document x ON x.document_id = c.document_id JOIN @knowledge_base k ON k.kb_id = x.kb_id LEFT JOIN @user_account u ON u.user_id = c.user_id
    LEFT JOIN @kb_member m ON m.user_id = c.user_id AND m.kb_id = x.kb_id LEFT JOIN @document_acl a ON a.document_id = x.document_id AND a.user_id = c.user_id"""

#: Cited chunks of an answer in their order, with what a reader needs; one that its user may not read any more is stale. Only these few
#: chunks meet the authorization.
EVIDENCE = f"""WITH asked AS (SELECT conv_id, turn, user_id, chunk_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, chunk_id) AS BIGINT) AS place FROM {CITED} c),
    open_ AS (SELECT q.conv_id, q.turn, q.chunk_id, r.document_id, c.version_id, c.line_no, x.title FROM asked q JOIN @indexed_chunk c ON c.chunk_id = q.chunk_id JOIN ({READY_GENERATION}) r ON r.generation_id = c.generation_id AND r.profile_id = c.profile_id
        JOIN @document x ON x.document_id = r.document_id JOIN @knowledge_base k ON k.kb_id = r.kb_id JOIN @kb_member m ON m.kb_id = r.kb_id AND m.user_id = q.user_id AND NOT m.revoked JOIN @user_account u ON u.user_id = q.user_id AND u.organization_id = k.organization_id WHERE {MAY_READ})
    SELECT a.conv_id, a.turn, a.place, a.chunk_id, o.document_id, v.version_no, o.title, o.line_no, t.line AS text, o.chunk_id IS NULL AS stale FROM asked a LEFT JOIN open_ o ON o.conv_id = a.conv_id AND o.turn = a.turn AND o.chunk_id = a.chunk_id
    LEFT JOIN @document_version v ON v.version_id = o.version_id LEFT JOIN @chunk t ON t.chunk_id = o.chunk_id"""
EVIDENCE_PLAIN = f"""SELECT q.conv_id, q.turn, (SELECT count(*) FROM {CITED} b WHERE b.conv_id = q.conv_id AND (b.turn, b.chunk_id) <= (q.turn, q.chunk_id)) AS place, q.chunk_id, a.document_id, v.version_no, x.title, t.line_no, a.line AS text, a.chunk_id IS NULL AS stale
    FROM {CITED} q LEFT JOIN ({AUTHORIZED}) a ON a.user_id = q.user_id AND a.chunk_id = q.chunk_id LEFT JOIN @document_version v ON v.version_id = a.version_id LEFT JOIN @document x ON x.document_id = a.document_id LEFT JOIN @chunk t ON t.chunk_id = a.chunk_id"""

#: Evidence of a request: its best candidates, so many in all and of a document.
MOST_EVIDENCE, MOST_OF_DOCUMENT = 6, 3
#: Chunks before and after the evidence, in its order, that the asker may read and that aren't found already; evidence of a document that
#: has all it may have brings none.
ADJACENT = f"""WITH capped AS (SELECT r.request_id, r.chunk_id, r.fusion_rank, c.document_id, c.generation_id, c.chunk_index, row_number() OVER (PARTITION BY r.request_id, c.document_id ORDER BY r.fusion_rank) AS of_document FROM @ranked_kept r JOIN @indexed_chunk c ON c.chunk_id = r.chunk_id),
    picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fusion_rank) AS place FROM capped WHERE of_document <= {MOST_OF_DOCUMENT}) p WHERE place <= {MOST_EVIDENCE}),
    seed AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY request_id, document_id) AS held FROM picked) p WHERE held < {MOST_OF_DOCUMENT}),
    near AS (SELECT request_id, generation_id, place, step, chunk_index + step AS chunk_index FROM seed LATERAL VIEW explode(array(-1, 1)) x AS step),
    found AS (SELECT n.request_id, c.chunk_id, n.place, n.step, row_number() OVER (PARTITION BY n.request_id, c.chunk_id ORDER BY n.place, n.step) AS again FROM near n JOIN @indexed_chunk c ON c.generation_id = n.generation_id AND c.chunk_index = n.chunk_index
        JOIN @search_request q ON q.request_id = n.request_id JOIN ({READY_GENERATION}) r ON r.generation_id = c.generation_id AND r.profile_id = c.profile_id JOIN @knowledge_base k ON k.kb_id = r.kb_id JOIN @kb_member m ON m.kb_id = r.kb_id AND m.user_id = q.user_id AND NOT m.revoked
        JOIN @user_account u ON u.user_id = q.user_id AND u.organization_id = k.organization_id WHERE {MAY_READ} AND NOT EXISTS (SELECT 1 FROM @ranked_kept x WHERE x.request_id = n.request_id AND x.chunk_id = c.chunk_id))
    SELECT request_id, chunk_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY place, step) AS BIGINT) AS place FROM found WHERE again = 1"""
ADJACENT_PLAIN = f"""WITH allowed AS MATERIALIZED ({AUTHORIZED}), hit AS (SELECT r.request_id, q.user_id, r.chunk_id, r.fusion_rank, c.document_id, c.version_id, c.chunk_index FROM @ranked_kept r JOIN @chunk c ON c.chunk_id = r.chunk_id JOIN @search_request q ON q.request_id = r.request_id),
    fits AS (SELECT * FROM hit h WHERE (SELECT count(*) FROM hit o WHERE o.request_id = h.request_id AND o.document_id = h.document_id AND o.fusion_rank < h.fusion_rank) < {MOST_OF_DOCUMENT}),
    picked AS (SELECT * FROM fits f WHERE (SELECT count(*) FROM fits o WHERE o.request_id = f.request_id AND o.fusion_rank < f.fusion_rank) < {MOST_EVIDENCE}),
    pair AS (SELECT p.request_id, a.chunk_id, min(p.fusion_rank * 2 + CASE WHEN a.chunk_index > p.chunk_index THEN 1 ELSE 0 END) AS turn FROM picked p JOIN allowed a ON a.user_id = p.user_id AND a.version_id = p.version_id AND abs(a.chunk_index - p.chunk_index) = 1
        WHERE (SELECT count(*) FROM picked o WHERE o.request_id = p.request_id AND o.document_id = p.document_id) < {MOST_OF_DOCUMENT} AND (p.request_id, a.chunk_id) NOT IN (SELECT request_id, chunk_id FROM hit) GROUP BY p.request_id, a.chunk_id)
    SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY turn) AS place FROM pair"""


DIMENSION = 64


def sound(d, v: str) -> str:
    """A vector that a cache may give out: of the profile's length, finite, of norm one."""
    return f"coalesce({d.size(v)} = {DIMENSION} AND {d.dot(v, v)} < 1e300 AND abs(sqrt({d.dot(v, v)}) - 1) <= 0.001, false)"


def cached(d) -> str:
    """For each model input that generations in the making need: the newest vector of a ready generation of the same organization and
    profile, whose document is alive. A vector that isn't sound is as good as none, even if an older one is."""
    chain = "FROM @chunk_input c JOIN @index_generation g ON g.generation_id = c.generation_id JOIN @document x ON x.document_id = c.document_id JOIN @knowledge_base k ON k.kb_id = x.kb_id"
    keys = "k.organization_id, g.profile_id, c.model_input_hash"
    wanted = f"wanted AS (SELECT k.organization_id, g.profile_id, c.model_input_hash AS hash, count(*) AS fan_out {chain} WHERE g.status = 'BUILDING' GROUP BY {keys})"
    newest = d.plan(
        # the newest is kept while counting, so a hash that a third of all chunks have is no group of its own
        lambda _: f"newest AS (SELECT k.organization_id, g.profile_id, c.model_input_hash AS hash, max_by(named_struct('chunk_id', c.chunk_id, 'v', e.embedding), named_struct('g', g.generation_id, 'c', -c.chunk_id)) AS n {chain} JOIN @cached_vector e ON e.chunk_id = c.chunk_id AND e.profile_id = g.profile_id WHERE g.status = 'READY' AND NOT x.deleted GROUP BY {keys}), found AS (SELECT organization_id, profile_id, hash, n.chunk_id, n.v FROM newest)",
        lambda _: f"found AS (SELECT * FROM (SELECT k.organization_id, g.profile_id, c.model_input_hash AS hash, c.chunk_id, e.embedding AS v, row_number() OVER (PARTITION BY {keys} ORDER BY g.generation_id DESC, c.chunk_id) AS place {chain} JOIN @cached_vector e ON e.chunk_id = c.chunk_id AND e.profile_id = g.profile_id WHERE g.status = 'READY' AND NOT x.deleted) f WHERE place = 1)",
    )
    return f"""{wanted}, {newest}, looked_up AS (SELECT w.organization_id, w.profile_id, w.hash, w.fan_out, f.chunk_id, CASE WHEN f.chunk_id IS NULL THEN 'MISS' WHEN {sound(d, "f.v")} THEN 'HIT' ELSE 'MALFORMED' END AS state
        FROM wanted w LEFT JOIN found f ON f.organization_id = w.organization_id AND f.profile_id = w.profile_id AND f.hash = w.hash)"""


OPERATORS = {
    "kb_scope": lambda d: "SELECT u.user_id, k.kb_id, m.role, k.profile_id, p.analyzer, p.dimension FROM @user_account u JOIN @kb_member m ON m.user_id = u.user_id AND NOT m.revoked JOIN @knowledge_base k ON k.kb_id = m.kb_id AND k.organization_id = u.organization_id LEFT JOIN @index_profile p ON p.profile_id = k.profile_id",
    "scope_resolution": lambda d: SCOPE,
    "authorized_chunks": lambda d: d.plan(
        lambda _: f"SELECT user_id, chunk_id, document_id, kb_id, chunk_index FROM ({AUTHORIZED}) a",
        lambda _: """SELECT u.user_id, c.chunk_id, c.document_id, x.kb_id, c.chunk_index FROM @chunk c JOIN @document x ON x.document_id = c.document_id AND x.active_version_id = c.version_id JOIN @user_account u
            ON EXISTS (SELECT 1 FROM @kb_member m WHERE m.kb_id = x.kb_id AND m.user_id = u.user_id AND NOT m.revoked) WHERE NOT x.deleted
            AND c.version_id IN (SELECT version_id FROM @document_version WHERE status = 'READY') AND u.organization_id = (SELECT max(k.organization_id) FROM @knowledge_base k WHERE k.kb_id = x.kb_id)
            AND (c.generation_id, (SELECT max(k.profile_id) FROM @knowledge_base k WHERE k.kb_id = x.kb_id)) IN (SELECT generation_id, profile_id FROM @index_generation WHERE status = 'READY')
            AND (c.chunk_id, (SELECT max(k.profile_id) FROM @knowledge_base k WHERE k.kb_id = x.kb_id)) IN (SELECT chunk_id, profile_id FROM @chunk_embedding)
            AND (x.acl_mode <> 'RESTRICTED' OR (x.document_id, u.user_id) IN (SELECT document_id, user_id FROM @document_acl))""",
    ),
    "acl_filter": lambda d: "SELECT x.document_id, u.user_id FROM @document x JOIN @knowledge_base k ON k.kb_id = x.kb_id JOIN @user_account u ON u.organization_id = k.organization_id WHERE NOT x.deleted AND (x.acl_mode = 'INHERIT' OR EXISTS (SELECT 1 FROM @document_acl a WHERE a.document_id = x.document_id AND a.user_id = u.user_id))",
    "evidence_fetch": lambda d: d.plan(lambda _: EVIDENCE, lambda _: EVIDENCE_PLAIN),
    "adjacent_evidence": lambda d: d.plan(lambda _: ADJACENT, lambda _: ADJACENT_PLAIN),
    "source_state": lambda d: SOURCE_STATE,
    "evidence_changed": lambda d: f"SELECT conv_id, turn, bool_or(NOT is_authorized OR NOT is_current) AS changed, count(*) AS expected FROM ({SOURCE_STATE}) s GROUP BY conv_id, turn",
    "accessible_kbs": lambda d: "SELECT u.user_id, m.kb_id, m.role FROM @user_account u JOIN @kb_member m ON m.user_id = u.user_id WHERE NOT m.revoked AND u.enabled AND CASE m.role WHEN 'READER' THEN 1 WHEN 'EDITOR' THEN 2 WHEN 'OWNER' THEN 3 ELSE 0 END >= 2",
    "valid_members": lambda d: "SELECT m.kb_id, u.user_id, u.username, m.role FROM @kb_member m JOIN @knowledge_base k ON k.kb_id = m.kb_id JOIN @user_account u ON u.user_id = m.user_id AND u.organization_id = k.organization_id WHERE NOT m.revoked ORDER BY m.kb_id, u.username",
    "member_replacement_diff": lambda d: f"""WITH both_ AS (SELECT coalesce(w.kb_id, m.kb_id) AS kb_id, coalesce(w.user_id, m.user_id) AS user_id, w.role AS new_role, m.role AS old_role, m.revoked FROM @desired_member w FULL OUTER JOIN @kb_member m ON m.kb_id = w.kb_id AND m.user_id = w.user_id),
        change AS (SELECT b.*, u.enabled, u.organization_id = k.organization_id AS local, CASE WHEN new_role IS NULL AND revoked THEN NULL WHEN new_role IS NULL THEN 'REVOKE' WHEN old_role IS NULL THEN 'ADD' WHEN revoked THEN 'REACTIVATE' WHEN old_role <> new_role THEN 'CHANGE_ROLE' ELSE 'KEEP' END AS action
            FROM both_ b JOIN @user_account u ON u.user_id = b.user_id JOIN @knowledge_base k ON k.kb_id = b.kb_id),
        verdict AS (SELECT kb_id, CASE WHEN bool_or(new_role IS NOT NULL AND NOT local) THEN 'FOREIGN_USER' WHEN bool_or(new_role = 'OWNER' AND NOT enabled AND (old_role IS NULL OR old_role <> 'OWNER' OR revoked)) THEN 'DISABLED_OWNER'
            WHEN NOT bool_or(coalesce(new_role = 'OWNER' AND enabled, false)) THEN 'NO_OWNER' ELSE 'OK' END AS verdict, bool_or(action IN ('ADD', 'REACTIVATE', 'CHANGE_ROLE', 'REVOKE')) AS changed FROM change GROUP BY kb_id)
        SELECT c.kb_id, c.user_id, c.action, v.verdict, k.kb_revision + CASE WHEN v.verdict = 'OK' AND v.changed THEN 1 ELSE 0 END AS kb_revision FROM change c JOIN verdict v ON v.kb_id = c.kb_id JOIN @knowledge_base k ON k.kb_id = c.kb_id WHERE c.action IS NOT NULL""",
    "acl_invalid_members": lambda d: "SELECT a.document_id, a.user_id FROM @document_acl a EXCEPT (SELECT x.document_id, u.user_id FROM @document x JOIN @knowledge_base k ON k.kb_id = x.kb_id JOIN @user_account u ON u.organization_id = k.organization_id AND u.enabled JOIN @kb_member m ON m.kb_id = x.kb_id AND m.user_id = u.user_id AND NOT m.revoked)",
    "acl_request_check": lambda d: "SELECT x.document_id, CASE WHEN x.acl_mode = 'INHERIT' AND count(a.user_id) > 0 THEN 'LIST_NOT_ALLOWED' WHEN count(a.user_id) <> count(DISTINCT a.user_id) THEN 'DUPLICATE_USER' ELSE 'OK' END AS verdict FROM @document x LEFT JOIN @acl_request a ON a.document_id = x.document_id GROUP BY x.document_id, x.acl_mode",
    "active_sessions_asof": lambda d: "SELECT s.session_id, u.user_id FROM @auth_session s JOIN @user_account u ON u.user_id = s.user_id AND u.organization_id = s.organization_id CROSS JOIN @as_of t WHERE s.revoked_at IS NULL AND s.created_at <= t.at AND s.expires_at > t.at AND u.enabled",
    "keyword_tokenize": lambda d: f"SELECT chunk_id, term, place FROM {d.each('@chunk_terms', 'terms', 'place', 'term')} q",
    "keyword_postings": lambda d: "SELECT term, chunk_id, tf, positions FROM @posting",
    "keyword_and_match": lambda d: "SELECT request_id, chunk_id FROM @keyword_match",
    "keyword_topk": lambda d: f"SELECT request_id, chunk_id, score, rank FROM ({KEYWORD_TOP}) k",
    "cover_density_rank": lambda d: "SELECT request_id, chunk_id, covers, score FROM @keyword_score",
    "vector_validate": lambda d: f"SELECT vec_id, CASE WHEN {d.size('embedding')} <> {DIMENSION} THEN 'DIMENSION' WHEN NOT ({d.dot('embedding', 'embedding')} < 1e300) THEN 'NON_FINITE' WHEN {d.dot('embedding', 'embedding')} = 0 THEN 'ZERO' WHEN abs(sqrt({d.dot('embedding', 'embedding')}) - 1) > 0.001 THEN 'NORM' ELSE 'OK' END AS reason FROM @embeddings",
    "l2_normalize": lambda d: f"SELECT vec_id, place, round(CAST(x AS DOUBLE) / norm, 6) + 0.0 AS x FROM {d.each('(SELECT vec_id, embedding, sqrt(' + d.dot('embedding', 'embedding') + ') AS norm FROM @embeddings)', 'embedding', 'place', 'x')} q",
    "vector_topk": lambda d: "SELECT request_id, chunk_id, score, rank FROM @vector_top",
    "embedding_cache_lookup": lambda d: f"WITH {cached(d)} SELECT organization_id, profile_id, hash, chunk_id, state FROM looked_up",
    "encode_plan": lambda d: f"WITH {cached(d)} SELECT organization_id, profile_id, hash, fan_out, CASE WHEN state = 'HIT' THEN 'HIT' ELSE 'MISS' END AS state FROM looked_up",
    "rrf_fusion": lambda d: "SELECT request_id, chunk_id, vector_rank, keyword_rank, round(score, 9) AS score, fusion_rank FROM @ranked",
    "rerank_apply": lambda d: f"WITH {rerank(SCORES)} SELECT request_id, chunk_id, fusion_rank, final_rank, rerank_unavailable FROM reranked",
    "hybrid_search": lambda d: "SELECT r.request_id, r.fusion_rank, r.chunk_id, r.vector_rank, r.keyword_rank, round(r.score, 9) AS fusion_score, c.document_id, c.line_no FROM @ranked r JOIN @indexed_chunk c ON c.chunk_id = r.chunk_id",
}
