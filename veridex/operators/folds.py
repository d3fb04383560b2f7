"""Ordered folds: a budget is spent item by item, and an item that doesn't fit is passed over while later ones are still tried.

A fold's group is small by construction (the turns of a window, the fused candidates of a request); embedding_batches reads a
version's chunks as a sorted stream. Null texts count as empty, and empty tables give no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..plans.run import Tables, apply
from .conversations import OPERATORS as CONVERSATIONS
from .retrieval import OPERATORS as RETRIEVAL
from .text import tokens

# Limits of a prompt and of an embedding request, and the marks of the evidence section.
INPUT_TOKENS, MOST_EVIDENCE, MOST_OF_DOCUMENT = 4000, 6, 3
BATCH_TEXTS, BATCH_BYTES, BATCH_POSITIONS, TEXT_CHARS, TEXT_TOKENS = 16, 262_144, 8192, 8000, 512
LINE_SEPARATORS = {"\u0085": "\\u0085", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def token_count(column: str) -> Column:
    return F.coalesce(F.expr(tokens(SPARK).replace("text", column)), F.lit(0))


def _spend(items: Column, budget: Column, verdict: Callable[[Column, Column], Column], fields: str) -> Column:
    """Folds items (structs with cost) to an array of structs (item, reason); verdict gives a reason or null for one that stays."""
    start = F.struct(budget.cast("long").alias("left"), F.expr(f"CAST(array() AS ARRAY<STRUCT<item: STRUCT<{fields}>, reason: STRING>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        reason = F.coalesce(verdict(state["out"], x), F.when(x["cost"] > state["left"], "budget"), F.lit("kept"))
        left = state["left"] - F.when(reason == "kept", x["cost"]).otherwise(F.lit(0).cast("long"))
        return F.struct(left.alias("left"), F.concat(state["out"], F.array(F.struct(x.alias("item"), reason.alias("reason")))).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def history_budget(turns: DataFrame, budget: int = INPUT_TOKENS) -> DataFrame:
    """(conv_id, turn, cost, reason) from (conv_id, turn, relevance, cost): by relevance (null lowest), then newest first."""
    item = F.struct((-F.coalesce(F.col("relevance").cast("double"), F.lit(float("-inf")))).alias("rank"), (-F.col("turn")).alias("newest"), F.col("cost").cast("long").alias("cost"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    fields = "rank: DOUBLE, newest: BIGINT, cost: BIGINT"
    out = held.select("conv_id", F.explode(_spend(F.col("items"), F.lit(budget), lambda out, x: F.lit(None).cast("string"), fields)).alias("x"))
    return out.select("conv_id", (-F.col("x.item.newest")).alias("turn"), F.col("x.item.cost").alias("cost"), "x.reason")


def evidence_pack(candidates: DataFrame) -> DataFrame:
    """(request_id, chunk_id, fusion_rank, reason) from (request_id, chunk_id, document_id, fusion_rank, cost, budget)."""
    item = F.struct(F.col("fusion_rank").cast("long").alias("rank"), "chunk_id", "document_id", F.col("cost").cast("long").alias("cost"))
    held = candidates.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("budget").alias("budget"))

    def verdict(out: Column, x: Column) -> Column:
        kept = F.filter(out, lambda o: o["reason"] == "kept")
        same = F.filter(kept, lambda o: o["item"]["document_id"] == x["document_id"])
        return F.when(F.size(kept) >= MOST_EVIDENCE, "max_evidence").when(F.size(same) >= MOST_OF_DOCUMENT, "max_per_document")

    fields = "rank: BIGINT, chunk_id: BIGINT, document_id: BIGINT, cost: BIGINT"
    out = held.select("request_id", F.explode(_spend(F.col("items"), F.col("budget"), verdict, fields)).alias("x"))
    return out.select("request_id", "x.item.chunk_id", F.col("x.item.rank").alias("fusion_rank"), "x.reason")


def evidence_render(kept: DataFrame) -> DataFrame:
    """(request_id, block) from (request_id, fusion_rank, text): a line of JSON for each item, in order, between two marks."""
    line = F.to_json(F.struct(F.concat(F.lit("E"), F.col("place").cast("string")).alias("evidence_id"), F.coalesce("text", F.lit("")).alias("text")))
    for mark, escape in LINE_SEPARATORS.items():
        line = F.replace(line, F.lit(mark), F.lit(escape))
    held = kept.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("fusion_rank", "text"))).alias("items"))
    each = held.select("request_id", F.posexplode("items").alias("at", "x")).select("request_id", (F.col("at") + 1).alias("place"), "x.text")
    lines = each.select("request_id", "place", line.alias("line")).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return lines.select("request_id", F.concat_ws("\n", F.lit("<evidence>"), F.col("lines.line"), F.lit("</evidence>")).alias("block"))


def embedding_batches(texts: DataFrame) -> DataFrame:
    """(job_id, place, batch, reason) from (job_id, place, text): greedy batches in order; a refused text has no batch."""
    sized = texts.select("job_id", "place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), token_count("text").alias("tokens"),
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").when(F.length("text") > TEXT_CHARS, "chars").when(token_count("text") > TEXT_TOKENS, "tokens").otherwise("ok").alias("reason"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, batch, n, size, longest = None, 0, 0, 0, 0
        for rows in batches:
            out = []
            for j, b, t, reason in zip(*(rows.column(c).to_pylist() for c in ("job_id", "bytes", "tokens", "reason")), strict=True):
                if j != job:
                    job, batch, n, size, longest = j, 0, 0, 0, 0
                if reason != "ok":
                    out.append(None)
                    continue
                if n and (n + 1 > BATCH_TEXTS or size + b > BATCH_BYTES or max(longest, t) * (n + 1) > BATCH_POSITIONS):
                    batch, n, size, longest = batch + 1, 0, 0, 0
                n, size, longest = n + 1, size + b, max(longest, t)
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column("job_id"), rows.column("place"), pa.array(out, pa.int64()), rows.column("reason")], names=["job_id", "place", "batch", "reason"])

    # a job's texts are read in order, with constant memory however many there are
    in_order = sized.repartition("job_id").sortWithinPartitions("job_id", "place")
    return in_order.mapInArrow(run, "job_id long, place long, batch long, reason string")


def encode_misses(chunks: DataFrame, cache: DataFrame, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(chunk_id, hash, vector, hit) from chunks (chunk_id, text) and cache (hash, vector); each missing text is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(batch.column(1).to_pylist()), pa.list_(pa.float64()))], names=["hash", "vector"])

    hashed = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
    known = cache.groupBy("hash").agg(F.first("vector").alias("vector")).select("hash", F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("hit"))
    missing = hashed.groupBy("hash").agg(F.first("text").alias("text")).join(known, "hash", "left_anti")
    fresh = missing.select("hash", "text").mapInArrow(run, "hash string, vector array<double>").withColumn("hit", F.lit(False))
    return hashed.select("chunk_id", "hash").join(known.unionByName(fresh), "hash").select("chunk_id", "hash", "vector", "hit")


def hashed_words(texts: list[str], dimensions: int = 16) -> list[list[float]]:
    """A stand-in encoder: counts of words by hash."""
    import zlib

    out = []
    for text in texts:
        row = [0.0] * dimensions
        for word in text.lower().split():
            row[zlib.crc32(word.encode("utf-8", "replace")) % dimensions] += 1.0
        out.append(row)
    return out


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    window = apply(spark, CONVERSATIONS["history_window"], tables).where("reason = 'eligible'").select("conv_id", "turn")
    turns = apply(spark, CONVERSATIONS["history_turns"], tables).join(window, ["conv_id", "turn"])
    relevance = F.expr("CASE WHEN turn % 4 <> 0 THEN CAST((conv_id * 7 + turn * 3) % 5 AS DOUBLE) END")
    return history_budget(turns.select("conv_id", "turn", relevance.alias("relevance"), (token_count("question") + token_count("answer")).alias("cost")), 120)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = Tables(spark, sf_dir)
    lines = tables["chunk"].select("chunk_id", "line")
    asked = tables["search_request"].select("request_id", (F.lit(600) - token_count("text")).alias("budget"))
    found = apply(spark, RETRIEVAL["hybrid_search"], tables).join(lines, "chunk_id").join(asked, "request_id").withColumn("cost", token_count("line"))
    return evidence_pack(found), lines


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, lines = _packed(spark, sf_dir)
    return evidence_render(packed.where("reason = 'kept'").join(lines, "chunk_id").select("request_id", "fusion_rank", F.col("line").alias("text")))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_batches(Tables(spark, sf_dir)["chunk"].select(F.col("version_id").alias("job_id"), F.col("chunk_index").alias("place"), F.col("line").alias("text")))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    cache = tables["chunk"].where("generation_id % 2 = 0").join(tables["chunk_embedding"].select("chunk_id", "embedding"), "chunk_id").select(F.sha2("line", 256).alias("hash"), F.col("embedding").alias("vector"))
    out = encode_misses(tables["chunk"].select("chunk_id", F.col("line").alias("text")), cache, hashed_words)
    return out.select("chunk_id", "hash", F.size("vector").alias("dimension"), "hit")


QUERIES = {
    "history_budget": _history,
    "evidence_pack": lambda spark, sf_dir: _packed(spark, sf_dir)[0],
    "evidence_render": _rendered,
    "embedding_batches": _batches,
    "encode_misses": _encoded,
}
