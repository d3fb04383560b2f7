"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text's letters are lower-cased and its words' character n-grams (one to four, with word borders) hashed to rows of an
embedding; the average of the rows goes through a linear layer and a softmax. Both are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A part of the sample sets the temperature of the softmax and the
score below which a prediction counts as rejected.

Text that is null or has no letter is `und` with score 0. With nothing to learn from, everything is `und`. Whole texts of any
length are read in stretches. Repeated rows score alike; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, strings, table, text_groups, uniform

BUCKETS, DIMENSIONS, ORDERS = 1 << 12, 16, 4
#: About so many labelled documents of each language are learned from.
SAMPLE = 1000
#: Share of right predictions that the rejection threshold would lose.
LOST = 0.01


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of each text, and whether it has a letter."""
    total = np.zeros((len(texts), BUCKETS), np.float32)
    seen = np.zeros(len(texts), bool)
    stretch = 1 << 19
    parts = [(i, t[a : a + stretch]) for i, t in enumerate(texts) for a in range(0, len(t), stretch)]
    for a, b in text_groups([t for _, t in parts], stretch):
        group = parts[a:b]
        low = [t.lower() for _, t in group]
        codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[codes]
        owner = np.repeat(np.fromiter((i for i, _ in group), np.int64, len(group)), [len(t) + 1 for t in low])
        owner = np.concatenate([owner[:1], owner])
        seen[np.unique(owner[is_letter])] = True
        c = np.where(is_letter, codes, 32).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        inside = np.ones(len(c), bool)
        for n in range(ORDERS):
            m = len(c) - n
            h = (h[:m] ^ c[n:]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            # a word border may only begin or end an n-gram
            inside = inside[:m] & (is_letter[n:] if n == 0 else (is_letter[n - 1 : m + n - 1] if n > 1 else True))
            keep = inside & (is_letter[n : m + n] | is_letter[:m]) if n else is_letter
            cell = owner[:m][keep] * BUCKETS + ((h[keep] >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
            total += np.bincount(cell, minlength=total.size).reshape(total.shape) if len(texts) <= 64 else _sparse(cell, total.shape)
    return total, seen


def _sparse(cell: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    where, n = np.unique(cell, return_counts=True)
    out.reshape(-1)[where] = n
    return out


@dataclass
class Model:
    names: list[str]
    embedding: np.ndarray
    linear: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean = x / np.maximum(1, x.sum(1, keepdims=True))
        return (mean @ self.embedding) @ self.linear + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, labels: list[str], steps: int = 1500, seed: int = 1) -> Model:
    names = sorted(set(labels))
    y = np.array([names.index(c) for c in labels], int)
    rng = np.random.default_rng(seed)
    model = Model(names, rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.5, (DIMENSIONS, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if len(names) < 2:
        return model
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    mean = x / np.maximum(1, x.sum(1, keepdims=True))
    for step in range(steps):
        i = rng.choice(train, 32)
        rate = 4.0 * (1 - step / steps)
        hidden = mean[i] @ model.embedding
        z = hidden @ model.linear + model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(i)), y[i]] -= 1
        p /= len(i)
        grad = p @ model.linear.T
        model.linear -= rate * hidden.T @ p
        model.bias -= rate * p.sum(0)
        rows = np.flatnonzero(mean[i].any(0))
        model.embedding[rows] -= 8 * rate * mean[i][:, rows].T @ grad
    if len(held):
        z = model.logits(x[held])

        def loss(t: float) -> float:
            s = z / t
            return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(held)), y[held]]).mean())

        model.temperature = min(np.geomspace(0.1, 10, 60).tolist(), key=loss)
        best = model.scores(x[held])
        right = best.max(1)[best.argmax(1) == y[held]]
        model.reject_below = float(np.quantile(right, LOST)) if len(right) else 0.0
    return model


def train(docs: DataFrame) -> Model | None:
    """On about SAMPLE rows of each language, chosen by a hash; executors send hashed counts, not texts."""
    known = docs.where(~held_out("doc_id", 4, 2)).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE / n))) for k, n in sizes.items()])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = strings(batch.column(1))
        for a in range(0, len(texts), 256):
            x, seen = counts(texts[a : a + 256])
            i = np.flatnonzero(seen)
            cells = [np.flatnonzero(r) for r in x[i]]
            yield {"doc_id": batch.column(0)[a : a + 256].take(pa.array(i)), "lang": batch.column(2)[a : a + 256].take(pa.array(i)), "cell": cells, "n": [r[c] for r, c in zip(x[i], cells, strict=True)]}

    chosen = known.where(uniform(F.col("doc_id"), F.lit(3)) < share).select("doc_id", "text", "lang")
    rows = map_arrow(chosen, run, "doc_id long, lang string, cell array<int>, n array<float>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[r["cell"]] = r["n"]
    return fit(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = strings(batch.column(1))
        for a in range(0, len(texts), 512):
            part = texts[a : a + 512]
            x, seen = counts(part)
            if model is None:
                best, score = ["und"] * len(part), np.zeros(len(part))
            else:
                p = model.scores(x)
                best = [model.names[k] if s else "und" for k, s in zip(p.argmax(1), seen, strict=True)]
                score = np.where(seen, p.max(1), 0.0)
            yield {"doc_id": batch.column(0)[a : a + 512], "held_out": batch.column(2)[a : a + 512], "lang_pred": best, "score": np.clip(np.round(score.astype(float), 6), 0, 1), "rejected": ~seen | (score < (model.reject_below if model else 1))}

    return map_arrow(docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out")), run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
