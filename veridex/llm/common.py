"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one map call are worked on in groups of about this many characters, which bounds numpy's temporary arrays.
GROUP_CHARS = 1 << 19
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where all executors and the driver can read and write: the session's spark.checkpoint.dir. Only a local session, whose
    executor is the driver, gets a folder of its own if that is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veridex-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame, batch: str = "8m", codec: str | None = None) -> DataFrame:
    """Writes df to a table in the shared folder and goes on from there: a lost executor costs no long lineage, the planner
    knows the table's size, and columns that a later step leaves out aren't read again. batch is what goes to a Python worker at
    once, codec the table's compression if it isn't the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veridex-cut-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, batch)
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(ARROW_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/veridex-cut-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_groups(texts: list[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about limit characters; a longer text stands alone."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > limit:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about size bytes, which bounds what a worker holds at once."""
    rows = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that turn one batch into dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for out in f(part):
                    yield pa.RecordBatch.from_arrays([pa.array(out[c.name], c.type) for c in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column | str, modulus: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves this rest."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: edges (a, b) of longs to rows (id, label), label being the smallest id reached.

    Each round turns the edges of every node towards the smallest neighbour (first those to larger nodes, then those to
    smaller ones), until only stars are left; nodes with many edges meet pre-aggregated minima only. Nodes without an edge
    don't appear."""
    def only_stars(e: DataFrame) -> bool:
        """Whether every larger end has one edge, to a node that is no larger end itself."""
        ends = e.select(F.col("a").alias("id"), F.lit(1).alias("larger")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("larger")))
        return ends.groupBy("id").agg(F.sum("larger").alias("larger"), F.count("*").alias("k")).where("larger > 0 and k > 1").isEmpty()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not only_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, now = now, cut(small.where("a <> b").distinct())
        forget(before)
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label")
    labels = cut(labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct()))
    forget(now)
    return labels


#: At most so many 8-byte keys are broadcast.
BROADCAST_ROWS = 500_000
