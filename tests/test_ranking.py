"""Coverage of gold spans and what rankings are worth, case by case."""

import math
import random

import pytest

from veridex.operators import ranking

C = "variant string, question_id string, rank int, candidate_id string, kb_id long, document_id string, version_id long, source_type string, parser_version string, start_line long, end_line long, page long"
S = "question_id string, span int, kb_id long, document_id string, version_id long, source_type string, parser_version string, start_line long, end_line long, page long"


def lines(a, b, doc="d", kind="markdown", parser="p", version=1):
    return (0, doc, version, kind, parser, a, b, None)


def page(n, doc="d"):
    return (0, doc, 1, "pdf", "p", None, None, n)


def scores(spark, questions):
    """questions: id -> (spans, [(rank, place)]); the row of each id."""
    spans = [(q, k, *s) for q, (gold, _) in questions.items() for k, s in enumerate(gold)]
    candidates = [("A", q, rank, f"c{rank:02}", *where) for q, (_, found) in questions.items() for rank, where in found]
    frames = spark.createDataFrame(candidates, C), spark.createDataFrame(spans, S), spark.createDataFrame([(q,) for q in questions], "question_id string")
    got = ranking.ranking_scores(*frames, frames[0])
    return {r.question_id: r for r in got.collect()}, got


def test_cases(spark):
    miss = (100, 200)
    got, _ = scores(
        spark,
        {
            "meets": ([lines(10, 20)], [(1, lines(15, 25))]),
            "apart": ([lines(10, 20)], [(1, lines(21, 25))]),
            "page": ([page(3)], [(1, page(3))]),
            "other page": ([page(3)], [(1, page(4))]),
            "parser": ([lines(1, 5)], [(1, lines(1, 5, parser="other")), (2, page(1)), (3, lines(1, 5, version=2)), (4, lines(1, 5, doc="e"))]),
            "twice": ([lines(1, 10)], [(1, lines(2, 3)), (2, lines(4, 5))]),
            "two spans": ([lines(1, 3), lines(4, 6)], [(1, lines(1, 6))]),
            "half": ([lines(1, 5, "a"), lines(1, 5, "b")], [(1, lines(1, 5, "a"))]),
            "eleventh": ([lines(1, 5)], [(k, lines(*miss)) for k in range(1, 11)] + [(11, lines(1, 5))]),
            "ideal": ([lines(1, 5, f"d{k}") for k in range(3)], [(k + 1, lines(1, 5, f"d{k}")) for k in range(3)]),
            "late": ([lines(1, 5, "a"), lines(1, 5, "b")], [(1, lines(50, 60)), (2, lines(1, 5, "a")), (3, lines(1, 5, "b"))]),
            "gaps in ranks": ([lines(1, 5)], [(7, lines(1, 5))]),
            "none": ([], [(1, lines(1, 5))]),
            "long": ([lines(1, 100_000)], [(1, lines(99_999, 200_000))]),
        },
    )
    two = 1 + 1 / math.log2(3)
    assert {q: (r.n, r.hit, r.recall) for q, r in got.items()} == {"meets": (1, 1, 1), "apart": (1, 0, 0), "page": (1, 1, 1), "other page": (1, 0, 0), "parser": (1, 0, 0), "twice": (1, 1, 1), "two spans": (2, 2, 1), "half": (2, 1, 0.5), "eleventh": (1, 0, 0), "ideal": (3, 3, 1), "late": (2, 2, 1), "gaps in ranks": (1, 1, 1), "none": (0, 0, None), "long": (1, 1, 1)}
    assert got["twice"].dcg == got["two spans"].dcg == got["gaps in ranks"].dcg == 1.0
    assert got["half"].ndcg == pytest.approx(1 / two)
    assert got["ideal"].ndcg == pytest.approx(1)
    assert got["late"].ndcg == pytest.approx((1 / math.log2(3) + 0.5) / two)
    assert got["eleventh"].dcg == 0 and got["none"].ndcg is None


def test_report(spark):
    two = [lines(1, 5, "a"), lines(1, 5, "b")]
    _, frame = scores(spark, {"ok": ([lines(1, 5, "a")], [(1, lines(1, 5, "a"))]), "miss": (two, [(1, lines(1, 5, "a"))]), "late": (two[:1], [(1, lines(9, 9)), (2, lines(1, 5, "a"))]), "r": ([], [(1, lines(1, 5))])})
    row = ranking.ranking_report(frame).first()
    assert (row.questions, row.hits, row.spans, row.failed_ids, row.excluded_ids) == (3, 3, 4, "late,miss", "r")
    assert row.macro_recall == round(2.5 / 3, 6)


def test_pairs_meet_once(spark):
    rng = random.Random(4)
    left = [("A", "q", k, f"c{k}", *lines(a := rng.randrange(400), a + rng.randrange(200))) for k in range(80)]
    right = [("q", k, *lines(a := rng.randrange(400), a + rng.randrange(200))) for k in range(60)]
    got = ranking.gold_overlap(spark.createDataFrame(left, C), spark.createDataFrame(right, S))
    want = [(c[2], s[1]) for c in left for s in right if c[9] <= s[8] and s[7] <= c[10]]
    assert sorted((r["rank"], r.span) for r in got.collect()) == sorted(want)
