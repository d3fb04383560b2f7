"""Answers of a model as JSON: whether they keep the agreed form, why not, and what they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.fixtures import DERIVED
from ..plans.run import Tables, apply, oracle

# Limits of an answer, and the names of its fields (either spelling, not both).
MOST_SENTENCES, MOST_CHARS, MOST_FOLLOW_UP = 64, 2000, 500
FIELDS = {"sentences": ("sentences",), "refused": ("insufficientEvidence", "insufficient_evidence"), "follow_up": ("followUp", "follow_up")}
SENTENCE = {"text": ("text",), "ids": ("citationIds", "citation_ids")}
BLANK = r"^\\s*$"


def _field(of: str, names: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"{of}['{n}']" for n in names) + ")"


def _once(of: str, fields: dict[str, tuple[str, ...]], needed: tuple[str, ...]) -> str:
    """Whether a map's keys are among these, none in two spellings, and the needed ones there."""
    every = ", ".join(f"'{n}'" for names in fields.values() for n in names)
    once = [f"NOT ({' AND '.join(f'''map_contains_key({of}, '{n}')''' for n in names)})" for names in fields.values() if len(names) > 1]
    there = [f"({' OR '.join(f'''map_contains_key({of}, '{n}')''' for n in fields[f])})" for f in needed]
    return " AND ".join([f"size(array_except(map_keys({of}), array({every}))) = 0", *once, *there])


def _is(variant: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({variant}) {f'''LIKE '{kind}<%' ''' if kind in ('ARRAY', 'OBJECT') else f'''= '{kind}' '''}, false)"


#: Sentences as maps, ids as variants: types are looked at, never converted.
PARSED = f"""parsed AS (SELECT *, try_parse_json(raw) AS v FROM @model_answer),
    top AS (SELECT *, CASE WHEN {_is('v', 'OBJECT')} THEN CAST(v AS MAP<STRING, VARIANT>) END AS m FROM parsed),
    held AS (SELECT *, CASE WHEN {_is(_field('m', FIELDS['sentences']), 'ARRAY')} THEN CAST({_field('m', FIELDS['sentences'])} AS ARRAY<VARIANT>) END AS s, {_field('m', FIELDS['refused'])} AS r, {_field('m', FIELDS['follow_up'])} AS f FROM top),
    maps AS (SELECT *, transform(s, x -> CASE WHEN {_is('x', 'OBJECT')} THEN CAST(x AS MAP<STRING, VARIANT>) END) AS sm FROM held),
    shaped AS (SELECT *, m IS NOT NULL AND {_once('m', FIELDS, ('sentences', 'refused'))} AND s IS NOT NULL AND {_is('r', 'BOOLEAN')} AND (f IS NULL OR {_is('f', 'VOID')} OR {_is('f', 'STRING')})
        AND forall(sm, x -> x IS NOT NULL AND {_once('x', SENTENCE, ('text', 'ids'))} AND {_is("x['text']", 'STRING')} AND {_is(_field('x', SENTENCE['ids']), 'ARRAY')} AND forall(CAST({_field('x', SENTENCE['ids'])} AS ARRAY<VARIANT>), i -> {_is('i', 'STRING')})) AS formed FROM maps),
    texts AS (SELECT *, CASE WHEN formed THEN CAST(r AS BOOLEAN) END AS refused, CASE WHEN formed THEN transform(sm, x -> named_struct('text', CAST(x['text'] AS STRING), 'ids', CAST({_field('x', SENTENCE['ids'])} AS ARRAY<STRING>))) END AS sentences, CASE WHEN {_is('f', 'STRING')} THEN CAST(f AS STRING) END AS follow_up FROM shaped),
    listed AS (SELECT request_id, collect_set(evidence_id) AS evidence FROM @answer_evidence GROUP BY request_id)"""

VERDICT = f"""CASE WHEN v IS NULL THEN 'BAD_JSON' WHEN m IS NULL THEN 'NO_OBJECT' WHEN NOT formed THEN 'BAD_FORM' WHEN size(sentences) > {MOST_SENTENCES} THEN 'TOO_MANY_SENTENCES' WHEN length(follow_up) > {MOST_FOLLOW_UP} THEN 'LONG_FOLLOW_UP'
    WHEN exists(sentences, x -> x.text RLIKE '{BLANK}') THEN 'BLANK_SENTENCE' WHEN exists(sentences, x -> length(x.text) > {MOST_CHARS}) THEN 'LONG_SENTENCE' WHEN exists(sentences, x -> size(x.ids) = 0) THEN 'NO_CITATIONS' WHEN exists(sentences, x -> size(x.ids) > {MOST_SENTENCES}) THEN 'TOO_MANY_CITATIONS'
    WHEN refused AND size(sentences) > 0 THEN 'REFUSAL_WITH_SENTENCES' WHEN refused THEN 'REFUSED' WHEN size(sentences) = 0 THEN 'NO_SENTENCES' WHEN size(array_except(flatten(sentences.ids), coalesce(evidence, array()))) > 0 THEN 'UNKNOWN_ID' ELSE 'OK' END"""


def answer_validate(spark: SparkSession, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, verdict) of answers (request_id, raw), whose evidence was (request_id, evidence_id).

    The first verdict that holds: no JSON (also with a name twice in one object), no object, a field too many, missing or of the
    wrong type, then limits and contents in turn; REFUSED and OK are good. Null texts are no JSON; extra columns are ignored."""
    text = f"WITH {PARSED} SELECT t.request_id, {VERDICT} AS verdict FROM texts t LEFT JOIN listed l ON l.request_id <=> t.request_id"
    return apply(spark, lambda _: text, {"model_answer": answers.select("request_id", "raw"), "answer_evidence": evidence})


def citation_ids(spark: SparkSession, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request_id, id, label, place) of good answers: each id once, in the order of first use; the label is the id without its E."""
    text = f"""WITH {PARSED}, good AS (SELECT t.request_id, array_distinct(flatten(sentences.ids)) AS ids FROM texts t LEFT JOIN listed l ON l.request_id <=> t.request_id WHERE {VERDICT} = 'OK')
        SELECT request_id, id, CASE WHEN startswith(id, 'E') THEN substr(id, 2) ELSE id END AS label, CAST(at + 1 AS BIGINT) AS place FROM good LATERAL VIEW posexplode(ids) x AS at, id"""
    return apply(spark, lambda _: text, {"model_answer": answers.select("request_id", "raw"), "answer_evidence": evidence})


def _text(d) -> str:
    return "replace(replace(replace(text, chr(34), ' '), chr(92), ' '), chr(10), ' ')"


def _shapes(d) -> str:
    """Answers of many forms, good and bad ones, around what an assistant said."""
    one = """concat('{"text": "', t, '", "citationIds": ["E2", "E1", "E2"]}')"""
    end = '"insufficientEvidence": false, "followUp": null}'
    forms = {
        0: f"""concat('{{"sentences": [', {one})""",
        1: f"concat('[', {one}, ']')",
        2: f"""concat('{{"sentences": [', {one}, '], "note": 1, {end}')""",
        3: f"'{{{end}'",
        4: f"""concat('{{"sentences": [', {one}, '], "insufficientEvidence": true}}')""",
        5: """'{"sentences": [], "insufficientEvidence": true, "followUp": "Which year?"}'""",
        6: f"""'{{"sentences": [], {end}'""",
        7: f"""concat('{{"sentences": [{{"text": "', t, '", "citationIds": []}}], {end}')""",
        8: f"""concat('{{"sentences": [', {one}, ', {{"text": "x", "citationIds": ["E9"]}}], {end}')""",
        9: f"""concat('{{"sentences": [', {one}, ', {{"text": "  ", "citationIds": ["E1"]}}], {end}')""",
        10: f"""concat('{{"sentences": [{{"text": "', repeat('long ', 401), '", "citationIds": ["E1"]}}], {end}')""",
        11: f"""concat('{{"sentences": [', {one}, repeat(concat(', ', {one}), 64), '], {end}')""",
        12: f"""concat('{{"sentences": [', {one}, '], "insufficientEvidence": "no"}}')""",
        13: f"""concat('{{"sentences": [{{"text": "', t, '", "citationIds": ["E1"], "score": 1}}], {end}')""",
        14: f"""concat('{{"sentences": [', {one}, '], "insufficientEvidence": false, "followUp": "', repeat('why ', 126), '"}}')""",
        15: """concat('{"sentences": [{"text": "', t, '", "citation_ids": ["E3", "legacy"]}], "insufficient_evidence": false}')""",
        16: f"""concat('{{"sentences": [{{"text": 7, "citationIds": ["E1"]}}], {end}')""",
    }
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in forms.items())
    return f"SELECT conv_id * 1000 + turn AS request_id, CASE (conv_id * 7 + turn) % 19 {cases} ELSE concat('{{\"sentences\": [', {one}, ', ', {one}, '], {end}') END AS raw FROM (SELECT conv_id, turn, {_text(d)} AS t FROM @conversations WHERE role = 'assistant') q"


DERIVED["model_answer"] = _shapes
DERIVED["answer_evidence"] = lambda d: "SELECT conv_id * 1000 + turn AS request_id, 'E1' AS evidence_id FROM @conversations WHERE role = 'assistant' UNION ALL SELECT conv_id * 1000 + turn, 'E2' FROM @conversations WHERE role = 'assistant' UNION ALL SELECT conv_id * 1000 + turn, 'E3' FROM @conversations WHERE role = 'assistant' AND conv_id % 2 = 0 UNION ALL SELECT conv_id * 1000 + turn, 'legacy' FROM @conversations WHERE role = 'assistant'"

QUERIES = {
    "answer_validate": lambda spark, sf_dir: answer_validate(spark, (t := Tables(spark, sf_dir))["model_answer"], t["answer_evidence"]),
    "citation_ids": lambda spark, sf_dir: citation_ids(spark, (t := Tables(spark, sf_dir))["model_answer"], t["answer_evidence"]),
}

#: The plain reading: paths into the text, one rule after another.
PLAIN = f"""text AS (SELECT request_id, CASE WHEN json_valid(raw) THEN raw END AS raw, json_valid(raw) AS ok FROM @model_answer), kinds AS (SELECT *, CASE WHEN ok THEN json_type(raw) END AS kind, CASE WHEN ok AND json_type(raw) = 'OBJECT' THEN json_keys(raw) END AS names FROM text),
    part AS (SELECT *, CASE WHEN kind = 'OBJECT' THEN json_extract(raw, '$.sentences[*]') END AS s, CASE WHEN kind = 'OBJECT' THEN coalesce(json_type(raw, '$.insufficientEvidence'), json_type(raw, '$.insufficient_evidence')) END AS r, CASE WHEN kind = 'OBJECT' THEN coalesce(json_type(raw, '$.followUp'), json_type(raw, '$.follow_up')) END AS f,
        CASE WHEN kind = 'OBJECT' THEN coalesce(json_extract_string(raw, '$.followUp'), json_extract_string(raw, '$.follow_up')) END AS follow FROM kinds),
    formed AS (SELECT *, kind = 'OBJECT' AND len(list_filter(names, lambda n: n NOT IN ('sentences', 'insufficientEvidence', 'insufficient_evidence', 'followUp', 'follow_up'))) = 0 AND coalesce(json_type(raw, '$.sentences') = 'ARRAY', false) AND coalesce(r = 'BOOLEAN', false) AND coalesce(f, 'NULL') IN ('NULL', 'VARCHAR')
        AND len(list_filter(s, lambda x: NOT coalesce(json_type(x) = 'OBJECT' AND len(list_filter(json_keys(x), lambda n: n NOT IN ('text', 'citationIds', 'citation_ids'))) = 0 AND json_type(x, '$.text') = 'VARCHAR' AND coalesce(json_type(x, '$.citationIds'), json_type(x, '$.citation_ids')) = 'ARRAY', false))) = 0 AS good FROM part),
    read_ AS (SELECT *, CASE WHEN good THEN list_transform(s, lambda x: json_extract_string(x, '$.text')) END AS texts, CASE WHEN good THEN list_transform(s, lambda x: list_concat(coalesce(json_extract_string(x, '$.citationIds[*]'), []), coalesce(json_extract_string(x, '$.citation_ids[*]'), []))) END AS ids, coalesce(json_extract_string(raw, '$.insufficientEvidence'), json_extract_string(raw, '$.insufficient_evidence')) = 'true' AS refused FROM formed WHERE ok
        UNION ALL SELECT *, NULL, NULL, NULL FROM formed WHERE NOT ok),
    judged AS (SELECT request_id, ids, CASE WHEN NOT ok THEN 'BAD_JSON' WHEN kind <> 'OBJECT' THEN 'NO_OBJECT' WHEN NOT good THEN 'BAD_FORM' WHEN len(texts) > {MOST_SENTENCES} THEN 'TOO_MANY_SENTENCES' WHEN length(follow) > {MOST_FOLLOW_UP} THEN 'LONG_FOLLOW_UP' WHEN len(list_filter(texts, lambda x: trim(x) = '')) > 0 THEN 'BLANK_SENTENCE'
        WHEN list_max(list_transform(texts, lambda x: length(x))) > {MOST_CHARS} THEN 'LONG_SENTENCE' WHEN len(list_filter(ids, lambda x: len(x) = 0)) > 0 THEN 'NO_CITATIONS' WHEN len(list_filter(ids, lambda x: len(x) > {MOST_SENTENCES})) > 0 THEN 'TOO_MANY_CITATIONS' WHEN refused AND len(texts) > 0 THEN 'REFUSAL_WITH_SENTENCES' WHEN refused THEN 'REFUSED' WHEN len(texts) = 0 THEN 'NO_SENTENCES'
        WHEN NOT list_has_all((SELECT list(evidence_id) FROM @answer_evidence e WHERE e.request_id = read_.request_id), flatten(ids)) THEN 'UNKNOWN_ID' ELSE 'OK' END AS verdict FROM read_)"""
ORACLES = {
    "answer_validate": oracle(lambda _: f"WITH {PLAIN} SELECT request_id, verdict FROM judged"),
    "citation_ids": oracle(lambda _: f"WITH {PLAIN}, used AS (SELECT request_id, unnest(flatten(ids)) AS id, unnest(range(len(flatten(ids)))) AS spot FROM judged WHERE verdict = 'OK'), firsts AS (SELECT request_id, id, min(spot) AS spot FROM used GROUP BY request_id, id) SELECT request_id, id, CASE WHEN starts_with(id, 'E') THEN substr(id, 2) ELSE id END AS label, row_number() OVER (PARTITION BY request_id ORDER BY spot) AS place FROM firsts"),
}
