"""Folds against plain loops, and their queries on the small tables."""

import json
import random

from veridex import registry
from veridex.operators import folds

SF = "/root/testdata/sf0.001"


def test_evidence_pack(spark):
    rng = random.Random(1)
    rows = [(q, q * 100 + r, rng.randrange(4), r, rng.randrange(1, 60), 120) for q in range(20) for r in range(1, 15)]
    got = {(r.request_id, r.chunk_id): r.reason for r in folds.evidence_pack(spark.createDataFrame(rows, "request_id long, chunk_id long, document_id long, fusion_rank int, cost int, budget int")).collect()}
    want = {}
    for q in range(20):
        left, docs = 120, []
        for _, chunk, doc, _, cost, _ in [r for r in rows if r[0] == q]:
            reason = "max_evidence" if len(docs) >= 6 else "max_per_document" if docs.count(doc) >= 3 else "budget" if cost > left else "kept"
            want[q, chunk] = reason
            if reason == "kept":
                left -= cost
                docs.append(doc)
    assert got == want
    assert set(want.values()) == {"kept", "budget", "max_evidence", "max_per_document"}


def test_history_budget(spark):
    rows = [(1, 1, None, 10), (1, 2, 0.5, 70), (1, 3, 0.5, 40), (1, 4, 0.9, 30), (2, 1, None, 101)]
    got = {(r.conv_id, r.turn): r.reason for r in folds.history_budget(spark.createDataFrame(rows, "conv_id long, turn long, relevance double, cost int"), 100).collect()}
    assert got == {(1, 4): "kept", (1, 3): "kept", (1, 2): "budget", (1, 1): "kept", (2, 1): "budget"}


def test_evidence_render_is_one_line_an_item(spark):
    text = 'a\n"b" c\u0085d\u2028e \u2029f'
    block = folds.evidence_render(spark.createDataFrame([(1, 2, None), (1, 1, text)], "request_id long, fusion_rank long, text string")).first().block
    lines = block.splitlines()
    assert len(lines) == 4
    assert [json.loads(x) for x in lines[1:3]] == [{"evidence_id": "E1", "text": text}, {"evidence_id": "E2", "text": ""}]


def test_embedding_batches(spark):
    rng = random.Random(2)
    texts = ["w " * rng.choice([1, 20, 300, 500, 600]) for _ in range(150)] + ["", None, "x" * 9000]
    got = {r.place: (r.batch, r.reason) for r in folds.embedding_batches(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "job_id long, place long, text string")).collect()}
    assert len(got) == len(texts)
    batches = {}
    for i, t in enumerate(texts):
        batch, reason = got[i]
        assert reason == ("blank" if not (t or "").strip() else "chars" if len(t) > 8000 else "tokens" if len(t.split()) > 512 else "ok")
        assert (batch is None) == (reason != "ok")
        if batch is not None:
            batches.setdefault(batch, []).append(len(t.split()))
    assert list(batches) == list(range(len(batches)))
    for b, sizes in batches.items():
        assert len(sizes) <= 16 and max(sizes) * len(sizes) <= 8192
        if b + 1 in batches:  # the next one's first text truly did not fit
            more = [*sizes, batches[b + 1][0]]
            assert len(more) > 16 or max(more) * len(more) > 8192


def test_encode_misses(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "b c"), (4, None)], "chunk_id long, text string")
    cache = chunks.where("chunk_id = 1").selectExpr("sha2(text, 256) AS hash", "array(9.0D) AS vector")
    got = {r.chunk_id: (list(r.vector), r.hit) for r in folds.encode_misses(chunks, cache, lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got == {1: ([9.0], True), 2: ([3.0], False), 3: ([3.0], False), 4: ([0.0], False)}


def test_queries(spark):
    for name in folds.QUERIES:
        assert registry.QUERIES[name](spark, SF).count() > 0, name
