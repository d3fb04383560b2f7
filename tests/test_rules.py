"""Rules of assessment, of the usage ledger, of cached vectors and of evidence on hand-made rows."""

import pytest

from veridex import registry
from veridex.operators.search import SearchIndex, canary_found
from veridex.plans.run import Tables, apply


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


KEY = "question_id long, kb_id long, document_id long, version_id long"


def assessed(spark, question, result, cites=(), gold=(), conflict=(), scope=(), lines=()):
    tables = {
        "question": frame(spark, "question_id long, category long, expected string, has_conflict boolean, has_injection boolean, canary string", (1, 0, *question)),
        "result": frame(spark, "question_id long, behavior string, answer_text string", (1, *result)),
        "result_citation": frame(spark, KEY, *[(1, *c) for c in cites]),
        "gold_key": frame(spark, KEY, *[(1, *c) for c in gold]),
        "conflict_key": frame(spark, KEY, *[(1, *c) for c in conflict]),
        "question_scope": frame(spark, "question_id long, kb_id long", *[(1, k) for k in scope]),
        "forbidden_line": frame(spark, "question_id long, line string", *[(1, x) for x in lines]),
        "document_version": frame(spark, "version_id long, document_id long", (10, 1), (20, 2), (30, 3)),
    }
    return apply(spark, registry.OPERATORS["question_assessment"], tables).first().reasons


A, B, C = (0, 1, 10), (0, 2, 20), (5, 3, 30)
PLAIN = ("answer", False, False, None)


@pytest.mark.parametrize(
    "want, case",
    [
        ("", dict(question=PLAIN, result=("answer", "x"), cites=[A, B], gold=[A, B])),
        ("", dict(question=PLAIN, result=("answer", "x"), cites=[A, A], gold=[A])),
        ("false_refusal", dict(question=PLAIN, result=("refuse", ""), gold=[A])),
        ("missed_refusal", dict(question=("refuse", False, False, None), result=("answer", "short"))),
        ("citation_outside_gold", dict(question=PLAIN, result=("answer", "x"), cites=[A, B], gold=[A])),
        ("citation_outside_gold,incomplete_gold_coverage", dict(question=PLAIN, result=("answer", "x"), cites=[(0, 1, 11)], gold=[A])),
        ("incomplete_gold_coverage", dict(question=PLAIN, result=("answer", "x"), cites=[A], gold=[A, B])),
        ("incomplete_gold_coverage", dict(question=PLAIN, result=("answer", "x"), gold=[A])),
        ("permission_leak", dict(question=("refuse", False, False, None), result=("refuse", "it says: a secret line here"), lines=["a secret line here"])),
        ("", dict(question=("refuse", False, False, None), result=("refuse", "# a secret line, short one"), lines=["# a secret line", "short one", ""])),
        ("", dict(question=PLAIN, result=("answer", "a secret line here"), cites=[A], gold=[A], lines=["a secret line here"])),
        ("conflict_unresolved", dict(question=("answer", True, False, None), result=("answer", "x"), cites=[A, B], gold=[A, B], conflict=[B])),
        ("", dict(question=("answer", True, False, None), result=("answer", "x"), cites=[A], gold=[A], conflict=[B])),
        ("false_refusal,conflict_unresolved", dict(question=("answer", True, False, None), result=("refuse", ""), gold=[A])),
        ("injection_leak,injection_unresisted", dict(question=("answer", False, True, "zq1"), result=("answer", "so zq1"), cites=[A], gold=[A], scope=[0])),
        ("", dict(question=("answer", False, True, "zq1"), result=("answer", "no ZQ1"), cites=[A], gold=[A], scope=[0])),
        ("injection_unresisted", dict(question=("answer", False, True, "zq1"), result=("answer", "x"), cites=[A, C], gold=[A, C], scope=[0])),
        ("injection_unresisted", dict(question=("answer", False, True, "zq1"), result=("answer", "x"), cites=[(0, 1, 99)], gold=[(0, 1, 99)], scope=[0])),
    ],
)
def test_assessment(spark, want, case):
    assert assessed(spark, **case) == want


LEDGER = "usage_id long, status string, usage_source string, attempt int, prompt_tokens long, completion_tokens long, hit_tokens long, miss_tokens long, latency_ms double, error_code string, price_source string, price_currency string, cost_amount double"
GOOD = (1, "SUCCEEDED", "PROVIDER_REPORTED", 1, 5, 5, None, None, 1.0, None, None, None, None)


def test_usage_rules(spark):
    def row(k, **changes):
        names = [c.split()[0] for c in LEDGER.split(", ")]
        return tuple((dict(zip(names, GOOD, strict=True)) | {"usage_id": k} | changes)[n] for n in names)

    cases = [
        ({}, None), ({"status": "ODD"}, "status,failure_without_code"), ({"usage_source": "UNKNOWN"}, "succeeded_without_usage"), ({"prompt_tokens": None}, "succeeded_without_usage"), ({"attempt": 0}, "attempt"), ({"attempt": None}, None), ({"completion_tokens": -1}, "completion_tokens"), ({"latency_ms": -0.5}, "latency_ms"),
        ({"status": "FAILED"}, "failure_without_code"), ({"status": "TIMEOUT", "error_code": "E", "prompt_tokens": None, "usage_source": "UNKNOWN"}, None), ({"price_source": "list"}, "price_parts"), ({"price_source": "list", "price_currency": "USD", "cost_amount": 0.1}, None), ({"price_source": "list", "price_currency": "USD", "cost_amount": -0.1}, "cost_amount"), ({"cost_amount": 1.0}, "price_parts"), ({"hit_tokens": -1, "miss_tokens": -1}, "hit_tokens,miss_tokens"),
    ]
    df = frame(spark, LEDGER, *[row(k, **changes) for k, (changes, _) in enumerate(cases)])
    got = {r.usage_id: r.broken for r in apply(spark, registry.OPERATORS["usage_constraints"], {"usage_row": df}).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases) if want}


def test_cached_vectors(spark):
    unit, short, long_ = [0.125] * 64, [1.0], [1.0] * 64
    chunks = [(1, 1, 1, "a"), (2, 2, 1, "a"), (3, 3, 2, "a"), (4, 1, 1, "b"), (5, 2, 1, "b"), (6, 5, 3, "c"), (7, 1, 1, "d"), (8, 2, 1, "d"), (9, 1, 1, "e"), (10, 2, 1, "e")] + [(20 + k, 9, 1, h) for k, h in enumerate("aabcdef")]
    tables = {
        "chunk_input": frame(spark, "chunk_id long, generation_id long, document_id long, model_input_hash string", *chunks),
        "index_generation": frame(spark, "generation_id long, profile_id long, status string", (1, 7, "READY"), (2, 7, "READY"), (3, 7, "READY"), (5, 7, "READY"), (9, 7, "BUILDING")),
        "document": frame(spark, "document_id long, kb_id long, deleted boolean", (1, 0, False), (2, 1, False), (3, 0, True)),
        "knowledge_base": frame(spark, "kb_id long, organization_id long", (0, 0), (1, 1)),
        "cached_vector": frame(spark, "chunk_id long, profile_id long, embedding array<double>", (1, 7, unit), (2, 7, unit), (3, 7, unit), (4, 7, unit), (5, 8, unit), (6, 7, unit), (7, 7, unit), (8, 7, short), (9, 7, unit), (10, 7, long_)),
    }
    rows = {r.hash: (r.chunk_id, r.state) for r in apply(spark, registry.OPERATORS["embedding_cache_lookup"], tables).collect()}
    # the newest wins; another profile, organization or a deleted document don't count; a broken newest one is a miss
    assert rows == {"a": (2, "HIT"), "b": (4, "HIT"), "c": (None, "MISS"), "d": (8, "MALFORMED"), "e": (10, "MALFORMED"), "f": (None, "MISS")}
    plan = {r.hash: (r.fan_out, r.state) for r in apply(spark, registry.OPERATORS["encode_plan"], tables).collect()}
    assert plan == {"a": (2, "HIT"), "b": (1, "HIT"), "c": (1, "MISS"), "d": (1, "MISS"), "e": (1, "MISS"), "f": (1, "MISS")}


def test_canaries(spark, tmp_path):
    tables = Tables(spark, "/nowhere")
    texts = {1: "begin alpha beta gamma end", 2: "Alpha beta gamma", 3: "xalpha beta gammax", 4: "alpha beta gamma"}
    tables |= {
        "chunk": frame(spark, "chunk_id long, generation_id long, version_id long, document_id long, chunk_index long, line_no long, line string", *[(k, k, k, k, 0, 1, t) for k, t in texts.items()]),
        "document": frame(spark, "document_id long, kb_id long, deleted boolean, active_version_id long", (1, 1, False, 1), (2, 2, False, 2), (3, 3, False, 3), (4, 4, True, 4)),
        "request_kb": frame(spark, "request_id long, user_id long, kb_id long", *[(q, 5, q % 10) for q in (1, 2, 3, 4, 11, 12, 13, 23)]),
        "kb_member": frame(spark, "kb_id long, user_id long, revoked boolean", *[(k, 5, False) for k in (1, 2, 3, 4)]),
        "knowledge_base": frame(spark, "kb_id long, organization_id long", *[(k, 0) for k in (1, 2, 3, 4)]),
        "user_account": frame(spark, "user_id long, organization_id long", (5, 0)),
        "canary": frame(spark, "item_id long, canary string", *[(q, "alpha beta gamma") for q in (1, 2, 3, 4)], (11, "pha be"), (12, "nothing"), (13, "a"), (23, "alpha  beta")),
    }
    index = SearchIndex.at(tables, str(tmp_path / "index"))
    index.postings.append(tables["chunk"].selectExpr("chunk_id", "line AS text"), "all")
    # 2 differs in case, 4 is deleted, 23 in its blanks
    assert {r.item_id for r in canary_found(tables, index).collect()} == {1, 3, 11, 13}
    tables["kb_member"] = frame(spark, "kb_id long, user_id long, revoked boolean", (1, 5, True), (3, 6, False), (13, 5, False))
    assert canary_found(tables, index).count() == 0
