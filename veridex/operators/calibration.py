"""A threshold for refusing: below it, or without a score, a question is refused."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.run import Tables, oracle

#: Ranges that scores are dealt into, by sampled quantiles.
RANGES = 128
FIXED = 0.5


def _rates(bad: str, good: str, all_bad: str, all_good: str) -> dict:
    """Of counts of refused and of all questions; null, not zero, where there is nothing to divide by."""
    accuracy, false_rate = F.try_divide(F.col(bad).cast("double"), F.col(all_bad)), F.try_divide(F.col(good).cast("double"), F.col(all_good))
    return {"refusal_accuracy": accuracy, "false_refusal_rate": false_rate, "balanced_accuracy": (accuracy + 1 - false_rate) / 2}


def _sums(records: DataFrame, *keys: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.count_if(F.col("expected") == "refuse").alias("bad"), F.count_if(F.col("expected") == "answer").alias("good"))


def calibration_scan(records: DataFrame) -> DataFrame:
    """(threshold, refused_bad, refused_good, refusal_accuracy, false_refusal_rate, balanced_accuracy) for each score of records
    (expected refuse or answer, score), and for the next doubles below the lowest and above the highest.

    Null scores are refused at every threshold; NaN and infinite ones count as null. Without a score there are no rows. Scores are
    summed first, then dealt into ranges between sampled quantiles, whose totals (RANGES rows) are carried on, so that no task meets
    all scores, wherever they lie."""
    finite = F.when(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score").cast("double") + 0.0)
    sums = _sums(records.select("expected", finite.alias("score")), "score")
    known = sums.where("score IS NOT NULL")
    found = known.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts")).first()
    if found.low is None:
        return records.sparkSession.createDataFrame([], "threshold double, refused_bad long, refused_good long, refusal_accuracy double, false_refusal_rate double, balanced_accuracy double")
    cuts = F.array(*[F.lit(c) for c in sorted(set(found.cuts))])
    dealt = known.withColumn("part", F.size(F.filter(cuts, lambda c: c <= F.col("score"))))
    parts = dealt.groupBy("part").agg(F.sum("bad").alias("part_bad"), F.sum("good").alias("part_good"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    carried = parts.select("part", *[F.coalesce(F.sum(f"part_{x}").over(before), F.lit(0)).alias(f"carried_{x}") for x in ("bad", "good")])
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.join(F.broadcast(carried), "part").select("score", *[(F.coalesce(F.sum(x).over(lower), F.lit(0)) + F.col(f"carried_{x}")).alias(x) for x in ("bad", "good")])
    total = known.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    edges = total.select(F.lit(math.nextafter(found.high, math.inf)).alias("score"), "bad", "good").unionByName(total.select(F.lit(math.nextafter(found.low, -math.inf)).alias("score"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("good")))
    missing = sums.agg(*[F.sum(F.when(F.col("score").isNull(), F.col(x)).otherwise(0)).alias(f"null_{x}") for x in ("bad", "good")], *[F.sum(x).alias(f"all_{x}") for x in ("bad", "good")])
    scan = running.unionByName(edges).join(F.broadcast(missing)).select(F.col("score").alias("threshold"), (F.col("bad") + F.col("null_bad")).alias("refused_bad"), (F.col("good") + F.col("null_good")).alias("refused_good"), "all_bad", "all_good")
    return scan.withColumns(_rates("refused_bad", "refused_good", "all_bad", "all_good")).drop("all_bad", "all_good")


def calibration_select(scan: DataFrame) -> DataFrame:
    """The row of the highest balanced accuracy, of equal ones the lowest threshold; none if no row has one."""
    return scan.where("balanced_accuracy IS NOT NULL").orderBy(F.desc(F.round("balanced_accuracy", 12)), "threshold").limit(1)


def calibration_fixed(records: DataFrame, threshold: float) -> DataFrame:
    """One row: the rates at a threshold that was chosen elsewhere, which must be finite."""
    if not math.isfinite(threshold):
        raise ValueError("the threshold must be finite")
    refused = F.coalesce(F.col("score") < threshold, F.lit(True)) | F.isnan("score")
    bad, good = F.col("expected") == "refuse", F.col("expected") == "answer"
    sums = records.agg(F.count_if(bad & refused).alias("refused_bad"), F.count_if(good & refused).alias("refused_good"), F.count_if(bad).alias("all_bad"), F.count_if(good).alias("all_good"), F.count("*").alias("questions"))
    return sums.withColumns(_rates("refused_bad", "refused_good", "all_bad", "all_good"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    rates = ("refusal_accuracy", "false_refusal_rate", "balanced_accuracy")
    return df.select(*[F.round(n, 6).alias(n) if n in rates else n for n in names])


QUERIES = {
    "calibration_scan": lambda spark, sf_dir: _rounded(calibration_scan(Tables(spark, sf_dir)["probe_record"]), "threshold", "refused_bad", "refused_good", "refusal_accuracy", "false_refusal_rate", "balanced_accuracy"),
    "calibration_select": lambda spark, sf_dir: _rounded(calibration_select(calibration_scan(Tables(spark, sf_dir)["probe_record"])), "threshold", "balanced_accuracy"),
    "calibration_fixed": lambda spark, sf_dir: _rounded(calibration_fixed(Tables(spark, sf_dir)["probe_record"], FIXED), "refusal_accuracy", "false_refusal_rate", "questions"),
}

#: The plain reading: each threshold of the grid with what lies below it, by binary search in the sorted scores.
SCAN = """sorted AS (SELECT list(score ORDER BY score) FILTER (WHERE expected = 'refuse' AND score IS NOT NULL) AS bad, list(score ORDER BY score) FILTER (WHERE expected = 'answer' AND score IS NOT NULL) AS good, count(*) FILTER (WHERE expected = 'refuse') AS all_bad, count(*) FILTER (WHERE expected = 'answer') AS all_good,
        count(*) FILTER (WHERE expected = 'refuse' AND score IS NULL) AS null_bad, count(*) FILTER (WHERE expected = 'answer' AND score IS NULL) AS null_good FROM @probe_record),
    grid AS (SELECT DISTINCT score AS threshold FROM @probe_record WHERE score IS NOT NULL UNION SELECT nextafter(min(score), CAST('-inf' AS DOUBLE)) FROM @probe_record HAVING count(score) > 0 UNION SELECT nextafter(max(score), CAST('inf' AS DOUBLE)) FROM @probe_record HAVING count(score) > 0),
    below AS (SELECT threshold, coalesce(sum(bad) OVER w, 0) AS bad, coalesce(sum(good) OVER w, 0) AS good FROM (SELECT g.threshold, count(*) FILTER (WHERE r.expected = 'refuse') AS bad, count(*) FILTER (WHERE r.expected = 'answer') AS good FROM grid g LEFT JOIN @probe_record r ON r.score = g.threshold GROUP BY g.threshold) q WINDOW w AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    scan AS (SELECT threshold, CAST(below.bad + null_bad AS BIGINT) AS refused_bad, CAST(below.good + null_good AS BIGINT) AS refused_good, (below.bad + null_bad) / nullif(CAST(all_bad AS DOUBLE), 0) AS accuracy, (below.good + null_good) / nullif(CAST(all_good AS DOUBLE), 0) AS rate FROM below, sorted)"""
ORACLES = {
    name: oracle(lambda _, text=text: text)
    for name, text in {
        "calibration_scan": f"WITH {SCAN} SELECT threshold, refused_bad, refused_good, round(accuracy, 6) AS refusal_accuracy, round(rate, 6) AS false_refusal_rate, round((accuracy + 1 - rate) / 2, 6) AS balanced_accuracy FROM scan",
        "calibration_select": f"WITH {SCAN} SELECT threshold, round((accuracy + 1 - rate) / 2, 6) AS balanced_accuracy FROM scan WHERE accuracy IS NOT NULL AND rate IS NOT NULL ORDER BY round((accuracy + 1 - rate) / 2, 12) DESC, threshold LIMIT 1",
        "calibration_fixed": f"""SELECT round(avg(CASE WHEN expected = 'refuse' THEN CASE WHEN score >= {FIXED} THEN 0.0E0 ELSE 1.0E0 END END), 6) AS refusal_accuracy, round(avg(CASE WHEN expected = 'answer' THEN CASE WHEN score >= {FIXED} THEN 0.0E0 ELSE 1.0E0 END END), 6) AS false_refusal_rate, count(*) AS questions FROM @probe_record""",
    }.items()
}
