"""Incremental ingestion of documents, and immutable snapshots of chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.run import Tables
from ..plans.shared import shared_folder

DOCUMENTS = "doc_id long, text string"
CHUNKS = "ingest_key string, doc_id long, chunk_index int, line string"
#: Hex digits of a key that name the part of the table where it is looked for.
PREFIX = 2


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents, each under a key made of its id and text; equal rows fall in one."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256).alias("ingest_key"), "doc_id", text.alias("text")).dropDuplicates(["ingest_key"])
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return keyed.select("ingest_key", "doc_id", F.posexplode(lines).alias("chunk_index", "line"))


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> DataFrame:
    """Reads the documents that source has and the checkpoint doesn't, and appends chunks of those that target lacks.

    A batch that is done again replaces its own folder, and keys of other folders are passed over, so a replay, even with a
    new checkpoint, adds nothing. The table of chunks is the state; none is kept in the stream. It is filed by the first digits of
    the key, and a batch reads the keys of its own digits only, so a small batch opens few files of a large table. Null texts give
    no chunk."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = f"{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-{batch_id}"
        chunks = chunked(batch).withColumn("prefix", F.substring("ingest_key", 1, PREFIX))
        mine = [r.prefix for r in chunks.select("prefix").distinct().collect()]  # at most 16 ** PREFIX
        known = stored_chunks(session, target).where(F.col("prefix").isin(mine) & (F.col("batch") != own)).select("ingest_key").distinct()
        fresh = chunks.join(known, "ingest_key", "left_anti")
        fresh.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{target}/batch={own}")

    docs = spark.readStream.schema(DOCUMENTS).parquet(source)
    docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stored_chunks(spark, target)


def stored_chunks(spark: SparkSession, target: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(f"{CHUNKS}, batch string, prefix string").parquet(target)


def snapshot_write(chunks: DataFrame, embeddings: DataFrame, generations: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Writes chunks (generation_id, chunk_id, ...) with their vectors as a new snapshot and counts what was written.

    Returns (generation_id, expected, chunks, vectors, complete) for every row of generations. A path that exists is an
    error, so a snapshot never changes. Files are split by a hash of generations, because these may be many and small."""
    spark = chunks.sparkSession
    vectors = embeddings.select("chunk_id", "embedding")
    rows = chunks.join(vectors, "chunk_id", "left").withColumn("bucket", F.pmod(F.xxhash64("generation_id"), F.lit(buckets)))
    rows.write.partitionBy("bucket").mode("errorifexists").parquet(path)
    found = spark.read.parquet(path).groupBy("generation_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))
    expected = chunks.groupBy("generation_id").agg(F.count("*").alias("expected"))
    out = generations.select("generation_id").join(expected, "generation_id", "left").join(found, "generation_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "chunks", "vectors")]
    return out.select("generation_id", *zero).withColumn("complete", F.expr("expected = chunks AND chunks = vectors"))


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/{{documents}}.parquet"  # a pattern, because a stream takes a single file only by pattern
    chunks = stream_ingest(spark, source, shared_folder(spark, "ingested"), shared_folder(spark, "ingest-state"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("ingest_key").alias("n_keys"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    chunks = tables["chunk"].select("generation_id", "chunk_id", "chunk_index", "line")
    return snapshot_write(chunks, tables["chunk_embedding"], tables["index_generation"], shared_folder(spark, "snapshot"))


QUERIES = {"stream_ingest": _ingested, "snapshot_write": _snapshot}
ORACLES = {
    "stream_ingest": """SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_chunks, count(*) AS n_keys
        FROM (SELECT DISTINCT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) q WHERE n > 0 GROUP BY doc_id""",
}
