"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled documents: one on the words of ordinary texts, the other
on words of toxic texts that ordinary ones hardly have (words of both kinds of text say nothing). The trainer cuts its content into
stretches; what it cuts off within a word is dropped from the toxic one. A window is a word between blanks. It is compressed with the
ordinary dictionary and with both; the bytes that the toxic one saves are evidence, if little is left of the window. Characters
are written as four bytes each, fixed at random, since otherwise a match costs as much as a short word does.

The border of what may be left, the weights of a logistic function of the evidence and the reject threshold are calibrated on
labelled rows apart from those that the dictionaries are trained on, the threshold apart from the weights too.

Null and empty texts score as a text without evidence. Whole texts of any length are read. Without labelled rows of both kinds
every score is about 0. Repeated rows score alike; extra columns are ignored."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_arrow, slices, strings, table, uniform

#: At most about so many labelled documents of each kind are fitted on.
SAMPLE = 3000
#: Bytes of the dictionaries, before the toxic one loses its fragments.
USUAL_BYTES, MARK_BYTES = 8192, 8192
#: A toxic window's words are so many times as frequent in toxic documents as in ordinary ones.
RATIO = 20
EDGES = b'.,!?:;"()*#&%$|'
FEATURES = 3
#: Bytes that the toxic dictionary saves at least in a window that counts.
LEAST_GAIN = 6
#: Bytes left of such a window at most; the border is calibrated below that.
MOST_LEFT = 14
#: A worker keeps the results of so many windows.
KEPT_WINDOWS = 100_000
#: Four bytes for each byte of a text.
WIDE = [bytes(x) for x in np.random.default_rng(7).integers(0, 256, (256, 4), dtype=np.uint8)]


def wide(text: bytes) -> bytes:
    return b"".join(map(WIDE.__getitem__, text))


def bag(text: str) -> tuple[list[bytes], int]:
    """The distinct windows of a text, sorted, and how many words it has."""
    found = [w.strip(EDGES) for w in text.lower().encode("utf-8", "replace").split()]
    return sorted({w for w in found if len(w) > 3}), len(found)


@dataclass
class Model:
    """Dictionary contents, weights and calibrated borders; small, so it travels with the tasks."""

    usual: bytes
    marks: bytes
    most_left: int = 9
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = -20.0
    reject_at: float = 0.7


class Windows:
    """Compressed lengths of windows with both dictionaries."""

    def __init__(self, usual: bytes, marks: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=7, min_match=5, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

        def compress(content: bytes):
            d = z.ZstdCompressionDict(wide(content), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return z.ZstdCompressor(compression_params=params, dict_data=d).compress

        self.ordinary, self.toxic = compress(usual), compress(usual + marks)
        self.base = len(self.toxic(b""))
        self.seen: dict[bytes, tuple[int, int]] = {}

    def gain(self, word: bytes) -> tuple[int, int]:
        """Bytes saved by the toxic dictionary, and bytes left with it."""
        if word not in self.seen:
            if len(self.seen) >= KEPT_WINDOWS:
                self.seen.clear()
            x = wide(b" " + word + b" ")
            left = len(self.toxic(x)) - self.base
            # a window of which much is left is no evidence, whatever the ordinary dictionary makes of it
            self.seen[word] = (len(self.ordinary(x)) - self.base - left if left <= MOST_LEFT else 0), left
        return self.seen[word]


@lru_cache(4)
def windows(usual: bytes, marks: bytes) -> Windows:
    return Windows(usual, marks)


def savings(model: Model, words: list[bytes]) -> list[tuple[int, int]]:
    """(bytes saved, bytes left) of the windows in which the toxic dictionary saves enough."""
    return [x for x in map(windows(model.usual, model.marks).gain, words) if x[0] >= LEAST_GAIN]


def evidence(saved: list[tuple[int, int]], n: int, most_left: int) -> list[float]:
    """Of a text of n words: how dense such windows are, what they save, and how many they are."""
    hits = [g for g, left in saved if left <= most_left]
    return [len(hits) / math.sqrt(n + 6), sum(hits) / math.sqrt(n + 6) / 16, min(len(hits), 3)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary that zstandard trains on the samples; all of them if they are too few for it."""
    import zstandard as z

    samples = [x for x in samples if len(x) >= 8]
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return z.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except z.ZstdError:  # too few samples
        return b"".join(samples)[:size]


def _joined(words: list[bytes]) -> bytes:
    return b"  ".join([b"", *words, b""])


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    of, against = Counter(w for d in toxic for w in d), Counter(w for d in ordinary for w in d)
    least = max(3, len(toxic) // 400)
    only = {w for w, n in of.items() if n >= least and against[w] * len(toxic) * RATIO <= n * len(ordinary)}
    usual = _trained([_joined(d) for d in ordinary], USUAL_BYTES, 48)
    marks = _trained([_joined([w for w in d if w in only]) for d in toxic], MARK_BYTES, 24)
    return Model(usual or b" ", _joined(sorted({w for w in marks.split() if w in only})))


def _parts(kinds: np.ndarray, names: list[int]) -> list[np.ndarray]:
    """Rows to train dictionaries on (8 of 10), for weights and for the threshold (1 each); all rows each time if one lacks a kind."""
    at = np.array(names) % 10
    parts = [at < 8, at == 8, at > 8]
    whole = all(len(set(kinds[p])) == 2 for p in parts)
    return parts if whole else [np.ones(len(kinds), bool)] * 3


def fit(rows: list[tuple[list[bytes], int, int]]) -> Model:
    """From (windows, number of words, label), on the driver: the caller bounds their number."""
    # equal bags are copies: one of them is enough, so that copies don't speak for their words again and again
    rows = list({(tuple(b), k): (b, n, k) for b, n, k in rows}.values())
    y = np.array([k for _, _, k in rows], int)
    if not len(y) or y.min() == y.max():
        return Model(b" ", b" ")
    of_dictionary, of_weights, of_threshold = _parts(y, [zlib.crc32(b"".join(b)) for b, _, _ in rows])
    bags = lambda part, kind: [rows[i][0] for i in np.flatnonzero(part & (y == kind))]
    model = train_dictionaries(bags(of_dictionary, 1), bags(of_dictionary, 0))

    rest = np.flatnonzero(of_weights | of_threshold)
    saved = [savings(model, rows[i][0]) for i in rest]
    y, of_weights, of_threshold = y[rest], of_weights[rest], of_threshold[rest]

    def features(left: int) -> np.ndarray:
        return np.array([evidence(x, rows[i][1], left) for x, i in zip(saved, rest, strict=True)])

    def told_apart(left: int) -> float:
        """The most that a border of the evidence's density takes of toxic rows over what it takes of ordinary ones."""
        dense, bad = features(left)[of_weights, 0], y[of_weights] == 1
        return max((dense[bad] >= c).mean() - (dense[~bad] >= c).mean() for c in np.unique(dense))

    model.most_left = max(range(5, MOST_LEFT + 1), key=lambda left: (told_apart(left), -left))
    x = features(model.most_left)
    z, t = x[of_weights], y[of_weights]
    scale = z.std(0) + 1e-6
    z = np.hstack([z / scale, np.ones((len(z), 1))])
    w, weight = np.zeros(z.shape[1]), np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    for _ in range(50):  # Newton's method with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - t)) / len(t) + 1e-3 * np.append(w[:-1], 0)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / len(t) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    # the scale is shifted so that the best border between the kinds lies at 0.7
    p, t = 1 / (1 + np.exp(-np.clip(x[of_threshold] / scale @ w[:-1] + w[-1], -30, 30))), y[of_threshold]
    cuts = np.unique(np.concatenate([p, [1.0]]))
    errors = [(p[t == 0] >= c).mean() + (p[t == 1] < c).mean() for c in cuts]
    best = int(np.argmin(errors))
    at = np.clip((cuts[best] + cuts[max(0, best - 1)]) / 2, 1e-6, 1 - 1e-6)
    shift = math.log(0.7 / 0.3) - math.log(at / (1 - at))
    model.weights, model.bias = (w[:-1] / scale).tolist(), float(w[-1] + shift)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", size: int = SAMPLE) -> list[tuple[list[bytes], int, int]]:
    """Bags of about size documents of each label, chosen by a hash of their ids; of whole texts, made by the executors."""
    known = labels.where(~held_out("doc_id", 3, 1)).where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, size / n))) for k, n in counts.items()], F.lit(0.0))
    chosen = known.where(uniform(F.col("doc_id"), F.lit(9)) < share)  # bounded by size for each label

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        bags = [bag(t) for t in strings(batch.column(0))]
        yield {"words": [b for b, _ in bags], "n": [n for _, n in bags], "label": batch.column(1)}

    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    found = map_arrow(rows, run, "words array<binary>, n long, label int").toArrow().to_pydict()
    return sorted(zip(found["words"], found["n"], found["label"], strict=True))


def scorer(model: Model):
    """The log odds of a text."""
    weights = np.array(model.weights)

    def odds(text: str) -> float:
        words, n = bag(text)
        return float(np.dot(weights, evidence(savings(model, words), n, model.most_left)) + model.bias)

    return odds


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = fit(labelled_sample(docs, labels))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        odds = scorer(model)
        scores = [round(1 / (1 + math.exp(-max(-30.0, min(30.0, odds(t))))), 6) for t in strings(batch.column(1))]
        yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": [int(s >= model.reject_at) for s in scores]}

    return map_arrow(docs.select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out")), run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the calibrated threshold rejects; learned as for the scores, so without the held-out third of labels."""
    model = fit(labelled_sample(docs, labels))
    border = math.log(model.reject_at / (1 - model.reject_at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = scorer(model)
        for batch in batches:
            for part in slices(batch):
                texts = strings(part.column(part.schema.get_field_index("text")))
                yield part.filter(pa.array([odds(t) < border for t in texts], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
