"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

A text's white space is deleted and its UTF-8 bytes are hashed chunk by chunk; chunk hashes combine as
hash(xy) = hash(x) * base**len(y) + hash(y), so that the chunks of a huge document are hashed by several tasks. Texts of
equal fingerprints are compared: all of them are streamed in chunks, and each chunk's smallest and largest value must be
the same. Groups that differ somewhere are split by the SHA-256 of the whole text.

Null counts as empty; all empty texts are equal. Of equal texts the row with most code points, then the smallest doc_id
stays (a null doc_id last); of rows that agree in all of these, one. Extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, strings, table, text_groups

#: What normalising deletes.
BLANKS = b" \t\n\x0b\x0c\r"
#: Two primes below 2**31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515249, 1220703133)
CHUNK = 1 << 15
#: Longer texts are hashed in pieces of this many characters by as many tasks as there are.
HUGE = 1 << 16
#: At most so many 8-byte keys are broadcast.
BROADCAST_ROWS = 500_000


def powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        row = [1]
        for _ in range(CHUNK - 1):
            row.append(row[-1] * b % p)
        out.append(np.array(row, np.uint64))
    return out[0], out[1]


POWERS = powers()


def combine(x: tuple[int, int], y: tuple[int, int], y_length: int) -> tuple[int, int]:
    """The hash of two byte strings in a row from theirs."""
    a, b = ((h * pow(base, y_length, p) + g) % p for h, g, base, p in zip(x, y, BASES, PRIMES, strict=True))
    return a, b


def fingerprints(parts: list[bytes]) -> list[tuple[int, int]]:
    """Of each byte string, from the hashes of its chunks."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    chunks = np.maximum(1, -(-lengths // CHUNK))
    owner = np.repeat(np.arange(len(parts)), chunks)
    first = np.repeat(chunks.cumsum() - chunks, chunks)
    sizes = np.minimum(CHUNK, lengths[owner] - (np.arange(len(owner)) - first) * CHUNK)
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    ends = sizes.cumsum()
    filled = np.flatnonzero(sizes)
    power = np.repeat(ends, sizes) - 1 - np.arange(len(data))
    hashes = np.zeros((2, len(owner)), np.uint64)
    if len(data):
        for k, p in enumerate(PRIMES):  # a chunk's sum stays below 2**54
            hashes[k, filled] = np.add.reduceat(data * POWERS[k][power], (ends - sizes)[filled]) % np.uint64(p)
    out: list[tuple[int, int]] = []
    for i, a, b, n in zip(owner.tolist(), *hashes.tolist(), sizes.tolist(), strict=True):
        if i == len(out):
            out.append((a, b))
        else:
            out[i] = combine(out[i], (a, b), n)
    return out


def _small(batch: pa.RecordBatch) -> Iterator[dict]:
    texts = strings(batch.column(1))
    for i, j in text_groups(texts, 1 << 20):
        parts = [t.encode().translate(None, BLANKS) for t in texts[i:j]]
        found = fingerprints(parts)
        yield {"doc_id": batch.column(0)[i:j], "row_hash": batch.column(2)[i:j], "points": batch.column(3)[i:j], "h1": [x[0] for x in found], "h2": [x[1] for x in found], "n_bytes": [len(x) for x in parts], "text_sha256": [hashlib.sha256(x).hexdigest() for x in parts]}


def _pieces(batch: pa.RecordBatch) -> Iterator[dict]:
    parts = [t.encode().translate(None, BLANKS) for t in strings(batch.column(2))]
    found = fingerprints(parts)
    yield {"uid": batch.column(0), "piece": batch.column(1), "h1": [x[0] for x in found], "h2": [x[1] for x in found], "n_bytes": [len(x) for x in parts]}


def _joined(batch: pa.RecordBatch) -> Iterator[dict]:
    out: dict[str, list] = {"uid": batch.column(0).to_pylist(), "h1": [], "h2": [], "n_bytes": []}
    for parts in batch.column(1).to_pylist():
        total, size = (0, 0), 0
        for p in parts:
            total, size = combine(total, (p["h1"], p["h2"]), p["n_bytes"]), size + p["n_bytes"]
        for k, x in zip(("h1", "h2", "n_bytes"), (*total, size), strict=True):
            out[k].append(x)
    yield out


def document_fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """(doc_id, row_hash, points, h1, h2, n_bytes, text_sha256) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("row_hash"), F.length(text).cast("long").alias("points"))
    numbers = "h1 long, h2 long, n_bytes long"
    small = map_arrow(rows.where(F.col("points") <= huge), _small, f"doc_id long, row_hash long, points long, {numbers}, text_sha256 string")
    large = rows.where(F.col("points") > huge).withColumn("text_sha256", F.sha2(F.translate("text", BLANKS.decode(), ""), 256))
    large = large.withColumn("uid", F.struct("row_hash", "points", "text_sha256"))
    # equal rows give equal pieces, so a row is known by its hashes
    cuts = large.select("uid", F.expr(f"explode(transform(sequence(0, int((points - 1) div {huge})), i -> struct(i as piece, substring(text, i * {huge} + 1, {huge}) as text)))").alias("x")).select("uid", "x.piece", "x.text")
    hashed = map_arrow(cuts.repartition("uid", "piece"), _pieces, f"uid struct<row_hash:long,points:long,text_sha256:string>, piece int, {numbers}").dropDuplicates(["uid", "piece"])
    joined = map_arrow(hashed.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("piece", "h1", "h2", "n_bytes"))).alias("parts")), _joined, f"uid struct<row_hash:long,points:long,text_sha256:string>, {numbers}")
    large = large.select("doc_id", "uid").join(joined, "uid").select("doc_id", "uid.row_hash", "uid.points", "h1", "h2", "n_bytes", "uid.text_sha256")
    return small.unionByName(large.select(small.columns))


def _groups(docs: DataFrame, chunk_chars: int = 1 << 14, salts: int = 64) -> DataFrame:
    """One row for each row of docs: what exact_groups() returns, and row_hash."""
    prints = cut(document_fingerprints(docs).withColumn("uid", F.monotonically_increasing_id()))
    key = ["h1", "h2", "n_bytes"]
    texts = prints.groupBy(*key, "row_hash").agg(F.count("*").alias("n"))
    many = texts.groupBy(key).agg(F.sum("n").alias("n")).where("n > 1")
    members = cut(texts.join(many.select(key), key, "left_semi").select(F.struct(key).alias("print"), "row_hash"))
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select(F.xxhash64(text).alias("row_hash"), text.alias("text")).join(members, "row_hash").select("print", F.translate("text", BLANKS.decode(), "").alias("text"))
    chunks = bare.select("print", F.expr(f"explode(transform(sequence(0, int(length(text) div {chunk_chars})), i -> struct(i as i, substring(text, i * {chunk_chars} + 1, {chunk_chars}) as part)))").alias("x"))
    # smallest and largest are kept for each task first, so a large group moves a row a task and chunk
    compared = chunks.groupBy("print", "x.i").agg(F.min("x.part").alias("low"), F.max("x.part").alias("high"))
    differ = cut(compared.where("low <> high").select("print.*").distinct().withColumn("differ", F.lit(True)))
    n_differ = differ.count()  # none, unless fingerprints of different texts are equal
    if n_differ:
        prints = prints.join(F.broadcast(differ) if n_differ <= BROADCAST_ROWS // 8 else differ, key, "left")
    prints = prints.withColumn("split", F.when(F.col("differ"), F.col("text_sha256")).otherwise("") if n_differ else F.lit(""))
    key = [*key, "split"]
    rows = prints.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("back"), F.bitwise_not("uid").alias("row")))
    part = rows.groupBy(*key, "salt").agg(F.count("*").alias("n"), best.alias("best"))
    whole = part.groupBy(key).agg(F.sum("n").alias("group_size"), F.max("best").alias("best"), F.collect_list("salt").alias("salts"))
    whole = whole.select(*key, "group_size", "best", F.explode("salts").alias("salt"))
    out = rows.join(whole, [*key, "salt"])
    return out.select("doc_id", F.bitwise_not("best.back").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("uid") == F.bitwise_not("best.row")).alias("kept"), "text_sha256", "row_hash")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs).drop("row_hash")


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts. Rows are told apart by doc_id (which may be null) and text; of rows that
    agree in both one stays, if any does. All empty texts are one group."""
    rows = cut(_groups(docs).where("group_size > 1").select("doc_id", "row_hash", "kept"))
    keys = rows.groupBy("doc_id", "row_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept")
    name = "_" * (1 + max(map(len, docs.columns))) + "row_hash"  # a name that no column of docs has
    keys = cut(keys.select(F.col("doc_id").alias(f"{name}_id"), F.col("row_hash").alias(f"{name}_key"), "kept"))
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    hashed = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = hashed[name].eqNullSafe(F.col(f"{name}_key")) & hashed["doc_id"].eqNullSafe(F.col(f"{name}_id"))
    out = hashed.join(keys, same, "left_anti")
    if not keys.where("kept").isEmpty():  # rows that are repeated in whole
        out = out.unionByName(hashed.join(keys.where("kept"), same, "left_semi").dropDuplicates(["doc_id", name]))
    return out.select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY points DESC, doc_id)"""
