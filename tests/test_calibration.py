"""Thresholds for refusing, case by case and against a plain scan."""

import math
import random

import pytest

from veridex.operators.calibration import calibration_fixed, calibration_scan, calibration_select

SCHEMA = "question_id long, expected string, score double"


def frame(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)


def plain(rows):
    scores = sorted({s for _, s in rows if s is not None and math.isfinite(s)})
    grid = [math.nextafter(scores[0], -math.inf), *scores, math.nextafter(scores[-1], math.inf)] if scores else []
    out = []
    for t in grid:
        refused = [e for e, s in rows if s is None or not math.isfinite(s) or s < t]
        out.append((t, refused.count("refuse"), refused.count("answer")))
    return out


def scanned(df):
    return sorted((r.threshold, r.refused_bad, r.refused_good) for r in calibration_scan(df).collect())


def test_grid_has_both_ends(spark):
    rows = [("answer", 0.2), ("answer", 0.8)]
    got = scanned(frame(spark, *rows))
    assert [t for t, _, _ in got] == [math.nextafter(0.2, -math.inf), 0.2, 0.8, math.nextafter(0.8, math.inf)]
    assert got == plain(rows)


def test_no_scores(spark):
    df = frame(spark, ("refuse", None))
    assert scanned(df) == [] and calibration_select(calibration_scan(df)).count() == 0
    assert scanned(df.limit(0)) == []


def test_selection_takes_the_lowest_of_equal_thresholds(spark):
    df = frame(spark, ("answer", 0.2), ("answer", 0.6), ("refuse", 0.0), ("refuse", 0.1))
    scan = calibration_scan(df)
    best = max(r.balanced_accuracy for r in scan.collect())
    assert calibration_select(scan).first().threshold == min(r.threshold for r in scan.collect() if r.balanced_accuracy == best) == 0.2
    # all equal: the one below the lowest score
    assert calibration_select(calibration_scan(frame(spark, ("answer", 0.5), ("refuse", 0.5)))).first().threshold == math.nextafter(0.5, -math.inf)


def test_no_usable_point(spark):
    scan = calibration_scan(frame(spark, ("answer", 0.9)))
    assert {r.balanced_accuracy for r in scan.collect()} == {None}
    assert calibration_select(scan).count() == 0


def test_scores_within_one_whole_number(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["refuse", "answer", "other", None]), rng.choice([rng.random(), rng.random() / 1e6, 0.5, None, math.nan, math.inf])) for _ in range(3000)]
    assert scanned(frame(spark, *rows)) == plain(rows)


def test_fixed(spark):
    row = calibration_fixed(frame(spark, ("refuse", 0.1), ("refuse", None), ("refuse", 0.9), ("answer", 0.1), ("answer", 0.5)), 0.5).first()
    assert (row.refused_bad, row.refused_good, row.refusal_accuracy, row.false_refusal_rate) == (2, 1, 2 / 3, 0.5)
    with pytest.raises(ValueError):
        calibration_fixed(frame(spark, ("refuse", 0.1)), math.inf)
