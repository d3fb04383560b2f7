"""Quality by importance resampling: a document's weight is the ratio of two generative models of its hashed n-grams, one of
target text and one of raw text, and documents are sampled without replacement by Gumbel top-k.

Both models are smoothed bag distributions over hashed one- and two-word n-grams. The raw model counts all documents; the target
model counts a bounded sample of those that labels mark as good. Counts are added up by the executors, one row for each task and bucket.
The kth largest noisy weight is found by narrowing histograms, so nothing grows on the driver.

Null and empty texts have weight 0 before noise. Repeated rows (same id) get the same noise. Ties at the border go to the smaller ids,
null counting as the largest; only rows of one id may pass k together. Without labelled good documents all weights are 0. Extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, strings, table, text_groups, uniform
from .ngram_join import mix, word_hashes

BUCKETS = 10_000
SMOOTHING = 1.0
#: The target model counts about so many of the documents that labels mark as good.
SAMPLE = 20_000


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the number of the text of each."""
    hashes, owner = word_hashes([t.lower().encode("utf-8", "replace") for t in texts])
    pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    same = owner[:-1] == owner[1:]
    return np.concatenate([hashes, pair[same]]) % np.uint64(BUCKETS), np.concatenate([owner, owner[1:][same]])


def _counts(batch: pa.RecordBatch) -> Iterator[dict]:
    texts = strings(batch.column(0))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good = np.array(batch.column(1).to_pylist(), bool)
    for a, b in text_groups(texts):
        cell, owner = _cells(texts[a:b])
        cell = cell.astype(np.int64)
        raw += np.bincount(cell, minlength=BUCKETS)
        target += np.bincount(cell[good[a:b][owner]], minlength=BUCKETS)
    i = np.flatnonzero(raw)
    yield {"bucket": i, "raw": raw[i].astype(np.int64), "target": target[i].astype(np.int64)}


def log_ratios(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    good = labels.where(F.col(label) == 1).select("doc_id").distinct()
    share = min(1.0, SAMPLE / max(1, good.count()))
    # about SAMPLE ids are broadcast, however many labels there are, so that no text moves
    good = good.where(uniform(F.col("doc_id"), F.lit(5)) < share).withColumn("good", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = map_arrow(marked, _counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for b, r, t in found:
        raw[b] += r
        target[b] += t
    if target.sum() == BUCKETS * SMOOTHING:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, log_weight): the sum of the log ratios of a text's n-grams."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = strings(batch.column(1))
        for a, b in text_groups(texts):
            cell, owner = _cells(texts[a:b])
            total = np.bincount(owner, ratios[cell.astype(np.int64)], minlength=b - a)
            yield {"doc_id": batch.column(0)[a:b], "log_weight": np.round(total, 6)}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, log_weight double")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The kth largest value, from histograms of ever narrower ranges."""
    low, high, above = *values.agg(F.min(column), F.max(column)).first(), 0
    if low is None or k <= 0:
        return math.inf
    while high > low:
        width = (high - low) / bins
        if low + width <= low or high - width >= high:
            break
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        found = {r[0]: (r[1], r[2], r[3]) for r in values.where(F.col(column).between(low, high)).groupBy(cell).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for c in sorted(found, reverse=True):
            n, a, b = found[c]
            if above + n >= k:
                low, high = a, b
                break
            above += n
        else:
            return low
        if found[c][0] == 1:
            break
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float = 0.85, seed: int = 7) -> DataFrame:
    """(doc_id, log_weight, noisy_weight, kept) of every row; about keep of all rows are kept (k = ceil(keep * rows))."""
    scored = weights(docs, log_ratios(docs, labels))
    gumbel = -F.log(-F.log(uniform(F.col("doc_id"), F.lit(seed))))
    scored = cut(scored.withColumn("noisy_weight", F.col("log_weight") + gumbel))
    k = math.ceil(keep * scored.count())
    border = kth_largest(scored, "noisy_weight", k)
    at, name = F.col("noisy_weight") == F.lit(border), F.coalesce("doc_id", F.lit((1 << 63) - 1))
    left, ties = k - scored.where(F.col("noisy_weight") > F.lit(border)).count(), scored.where(at)
    last = -kth_largest(ties.select((-name).alias("x")), "x", left) if ties.count() > left else (1 << 63) - 1
    return scored.withColumn("kept", (F.col("noisy_weight") > F.lit(border)) | at & (name <= F.lit(last)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
