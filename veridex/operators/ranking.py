"""Ranked candidates against the spans that answer a question: which covers which, and what the top ten are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.run import Tables, oracle

TOP = 10
#: Lines of a bin. Intervals meet where they share a bin, so a long version isn't compared with itself line by line.
BIN = 32
SOURCE = ["question_id", "kb_id", "document_id", "version_id", "source_type", "parser_version"]


def _binned(df: DataFrame, name: str) -> DataFrame:
    """Intervals (lines, or a page as one) with a row for each bin they touch; those without a place are left out."""
    low, high = F.coalesce("start_line", "page").alias(f"{name}_low"), F.coalesce("end_line", "page").alias(f"{name}_high")
    placed = df.withColumns({f"{name}_low": low, f"{name}_high": high}).where(f"{name}_low <= {name}_high")
    bins = F.sequence(F.floor(F.col(f"{name}_low") / BIN), F.floor(F.col(f"{name}_high") / BIN))
    return placed.drop("start_line", "end_line", "page").withColumn("bin", F.explode(bins))


def gold_overlap(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """(variant, question_id, rank, candidate_id, span): candidates that cover a span of their question.

    Both have question_id, kb_id, document_id, version_id, source_type, parser_version and a locator: start_line and end_line, or
    page. All names must agree and lines must meet, or pages be the same. A null name or place covers nothing. Each pair has one
    row, at the first bin that both touch; repeated rows give pairs of their own."""
    left, right = _binned(candidates, "c"), _binned(spans, "s")
    met = left.join(right, [*SOURCE, "bin"]).where("c_low <= s_high AND s_low <= c_high AND bin = greatest(floor(c_low / {0}), floor(s_low / {0}))".format(BIN))
    return met.select("variant", "question_id", "rank", "candidate_id", "span")


def ranking_scores(candidates: DataFrame, spans: DataFrame, questions: DataFrame, variants: DataFrame) -> DataFrame:
    """A row for each question (question_id) and variant: n spans, how many the top ten cover, recall, dcg, idcg and ndcg.

    Places are counted by rank, then candidate_id. A place gains if it is the first to cover some span. Without spans the ratios
    are null."""
    order = Window.partitionBy("variant", "question_id").orderBy("rank", "candidate_id")
    top = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
    placed = gold_overlap(top.drop("rank").withColumnRenamed("place", "rank"), spans)
    first = placed.groupBy("variant", "question_id", "span").agg(F.min("rank").alias("place"))
    gained = first.groupBy("variant", "question_id", "place").agg(F.count("*").alias("covered"))
    by_question = gained.groupBy("variant", "question_id").agg(F.sum("covered").alias("hit"), F.sum(1 / F.log2(F.col("place") + 1.0)).alias("dcg"))
    n = spans.groupBy("question_id").agg(F.count_distinct("span").alias("n"))
    all_ = questions.select("question_id").distinct().join(variants.select("variant").distinct(), how="cross").join(n, "question_id", "left").join(by_question, ["variant", "question_id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(TOP)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
    filled = all_.select("variant", "question_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"), F.coalesce(F.when(F.col("n") > 0, ideal), F.lit(0.0)).alias("idcg"))
    return filled.withColumns({"recall": F.try_divide(F.col("hit").cast("double"), F.col("n")), "ndcg": F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))})


def ranking_report(scores: DataFrame) -> DataFrame:
    """A row for each variant: means over questions with spans, sums behind them, ids that fall short in recall or ndcg, and ids
    without spans, which no mean counts."""
    has = F.col("n") > 0
    short = has & ((F.col("recall") < 1) | (F.round("ndcg", 12) < 1))

    def ids(condition) -> F.Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.col("question_id")))), lambda x: x.cast("string")), ",")

    return scores.groupBy("variant").agg(
        F.count_if(has).alias("questions"),
        F.sum(F.when(has, F.col("hit"))).alias("hits"),
        F.sum(F.when(has, F.col("n"))).alias("spans"),
        F.round(F.avg("recall"), 6).alias("macro_recall"),
        F.round(F.avg("ndcg"), 6).alias("macro_ndcg"),
        F.round(F.sum(F.when(has, F.col("dcg"))), 6).alias("dcg"),
        F.round(F.sum(F.when(has, F.col("idcg"))), 6).alias("idcg"),
        ids(short).alias("failed_ids"),
        ids(~has).alias("excluded_ids"),
    )


def _scores(tables: Tables) -> DataFrame:
    return ranking_scores(tables["located_candidate"], tables["located_span"], tables["asked_question"], tables["located_candidate"])


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    return gold_overlap(tables["located_candidate"], tables["located_span"]).select("variant", "question_id", "rank", "span")


QUERIES = {
    "gold_overlap": _overlap,
    "recall_at_10": lambda spark, sf_dir: _scores(Tables(spark, sf_dir)).where("n > 0").select("variant", "question_id", "hit", "n", F.round("recall", 6).alias("recall")),
    "ndcg_at_10": lambda spark, sf_dir: _scores(Tables(spark, sf_dir)).where("n > 0").select("variant", "question_id", F.round("ndcg", 6).alias("ndcg")),
    "ranking_report": lambda spark, sf_dir: ranking_report(_scores(Tables(spark, sf_dir))),
}

#: The plain reading: every candidate of a question beside every span of it.
MEETS = """c.question_id = g.question_id AND c.kb_id = g.kb_id AND c.document_id = g.document_id AND c.version_id = g.version_id AND c.source_type = g.source_type AND c.parser_version = g.parser_version
    AND (c.source_type = 'pdf' AND c.page = g.page OR c.source_type <> 'pdf' AND NOT (c.end_line < g.start_line OR g.end_line < c.start_line))"""
PLACED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY variant, question_id ORDER BY rank, candidate_id) AS place FROM @located_candidate),
    every AS (SELECT v.variant, q.question_id FROM (SELECT DISTINCT question_id FROM @asked_question) q, (SELECT DISTINCT variant FROM @located_candidate) v),
    pair AS (SELECT c.variant, c.question_id, c.place, g.span FROM placed c, @located_span g WHERE c.place <= {TOP} AND {MEETS}),
    score AS (SELECT e.variant, e.question_id, (SELECT count(DISTINCT g.span) FROM @located_span g WHERE g.question_id = e.question_id) AS n, (SELECT count(DISTINCT p.span) FROM pair p WHERE p.variant = e.variant AND p.question_id = e.question_id) AS hit,
        coalesce((SELECT sum(1 / log2(place + 1)) FROM (SELECT DISTINCT place FROM pair p WHERE p.variant = e.variant AND p.question_id = e.question_id AND NOT EXISTS (SELECT 1 FROM pair o WHERE o.variant = p.variant AND o.question_id = p.question_id AND o.span = p.span AND o.place < p.place)) f), 0) AS dcg FROM every e),
    full_score AS (SELECT *, list_sum(list_transform(range(1, least(n, {TOP}) + 1), lambda k: 1 / log2(k + 1))) AS idcg FROM score)"""
ORACLES = {
    name: oracle(lambda _, text=text: text)
    for name, text in {
        "gold_overlap": f"SELECT c.variant, c.question_id, c.rank, g.span FROM @located_candidate c, @located_span g WHERE {MEETS}",
        "recall_at_10": f"WITH {PLACED} SELECT variant, question_id, hit, n, round(CAST(hit AS DOUBLE) / n, 6) AS recall FROM full_score WHERE n > 0",
        "ndcg_at_10": f"WITH {PLACED} SELECT variant, question_id, round(dcg / idcg, 6) AS ndcg FROM full_score WHERE n > 0",
        "ranking_report": f"""WITH {PLACED} SELECT variant, count(*) FILTER (WHERE n > 0) AS questions, CAST(sum(hit) FILTER (WHERE n > 0) AS BIGINT) AS hits, CAST(sum(n) FILTER (WHERE n > 0) AS BIGINT) AS spans, round(avg(CAST(hit AS DOUBLE) / n) FILTER (WHERE n > 0), 6) AS macro_recall,
            round(avg(dcg / idcg) FILTER (WHERE n > 0), 6) AS macro_ndcg, round(sum(dcg) FILTER (WHERE n > 0), 6) AS dcg, round(sum(idcg) FILTER (WHERE n > 0), 6) AS idcg,
            coalesce(string_agg(CAST(question_id AS STRING), ',' ORDER BY question_id) FILTER (WHERE n > 0 AND (hit < n OR round(dcg / idcg, 12) < 1)), '') AS failed_ids, coalesce(string_agg(CAST(question_id AS STRING), ',' ORDER BY question_id) FILTER (WHERE n = 0), '') AS excluded_ids FROM full_score GROUP BY variant""",
    }.items()
}
