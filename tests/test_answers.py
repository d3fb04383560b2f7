"""Answers as JSON, case by case."""

import json

import pytest

from veridex.operators.answers import answer_validate, citation_ids


def answer(**changes):
    return json.dumps({"sentences": [{"text": "制度规定。", "citationIds": ["E1"]}], "insufficientEvidence": False, "followUp": None} | changes, ensure_ascii=False)


def one(**changes):
    return answer(sentences=[{"text": "x", "citationIds": ["E1"]} | changes])


CASES = [
    (answer(), "OK"),
    (answer(sentences=[{"text": "a", "citationIds": ["E2", "E1", "E2"]}, {"text": "b", "citationIds": ["E1"]}]), "OK"),
    ('{"sentences": [{"text": "x", "citation_ids": ["E1"]}], "insufficient_evidence": false}', "OK"),
    (answer(sentences=[], insufficientEvidence=True), "REFUSED"),
    (answer(insufficientEvidence=True), "REFUSAL_WITH_SENTENCES"),
    (answer(sentences=[]), "NO_SENTENCES"),
    (one(citationIds=["E9"]), "UNKNOWN_ID"),
    (one(citationIds=[]), "NO_CITATIONS"),
    (one(text="  \n"), "BLANK_SENTENCE"),
    (one(text=""), "BLANK_SENTENCE"),
    (one(text="x" * 2000), "OK"),
    (one(text="x" * 2001), "LONG_SENTENCE"),
    (answer(sentences=[{"text": "x", "citationIds": ["E1"]}] * 64), "OK"),
    (answer(sentences=[{"text": "x", "citationIds": ["E1"]}] * 65), "TOO_MANY_SENTENCES"),
    (answer(followUp="x" * 501), "LONG_FOLLOW_UP"),
    (answer(followUp=3), "BAD_FORM"),
    (answer(extra=1), "BAD_FORM"),
    (one(score=1), "BAD_FORM"),
    (one(text=3), "BAD_FORM"),
    (one(citationIds="E1"), "BAD_FORM"),
    (one(citationIds=[1]), "BAD_FORM"),
    (answer(insufficientEvidence="no"), "BAD_FORM"),
    (answer(insufficientEvidence=0), "BAD_FORM"),
    (answer(sentences=["x"]), "BAD_FORM"),
    (answer(sentences=None), "BAD_FORM"),
    ('{"insufficientEvidence": false}', "BAD_FORM"),
    ('{"sentences": []}', "BAD_FORM"),
    ("[1]", "NO_OBJECT"),
    ('"text"', "NO_OBJECT"),
    ("not json", "BAD_JSON"),
    (answer()[:-1], "BAD_JSON"),
    ("", "BAD_JSON"),
    (None, "BAD_JSON"),
]


@pytest.fixture(scope="module")
def frames(spark):
    answers = spark.createDataFrame([(k, raw, "clash") for k, (raw, _) in enumerate(CASES)], "request_id long, raw string, v string")
    evidence = spark.createDataFrame([(k, e) for k in range(len(CASES)) for e in ("E1", "E2")], "request_id long, evidence_id string")
    return answers, evidence


def test_verdicts(spark, frames):
    got = {r.request_id: r.verdict for r in answer_validate(spark, *frames).collect()}
    assert [got[k] for k in range(len(CASES))] == [v for _, v in CASES]


def test_ids_in_order_of_first_use(spark, frames):
    rows = sorted((r.request_id, r.place, r.id, r.label) for r in citation_ids(spark, *frames).collect())
    assert rows[:4] == [(0, 1, "E1", "1"), (1, 1, "E2", "2"), (1, 2, "E1", "1"), (2, 1, "E1", "1")]
    assert {r[0] for r in rows} == {k for k, (_, v) in enumerate(CASES) if v == "OK"}


def test_no_evidence_and_no_rows(spark, frames):
    answers, evidence = frames
    assert answer_validate(spark, answers.limit(1), evidence.limit(0)).first().verdict == "UNKNOWN_ID"
    assert answer_validate(spark, answers.limit(0), evidence).count() == 0
