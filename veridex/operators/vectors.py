"""Exact search among stored blocks of vectors, by bounds.

Vectors are dealt into cells around the vectors of a bounded sample and cells into blocks of bounded size; a block is stored as
one matrix with its centre and the radius that covers its rows, and the ids of its chunks with the row of each: equal vectors are
one row. Who may read what stays out of the store: at search time each
block's rows are told apart by unit (a set of rows that is readable as a whole), and a request comes with its units.

For a request q and a block with centre c and radius r, every product lies between q.c - |q| r and q.c + |q| r. The lower bounds
of the blocks in which a request may read give a score that its kth best surely reaches; a block whose upper bound lies below that
isn't touched. Bounds are worked out from centres alone, and pairs of a request and a block are rows of a few bytes until then.
What is left is multiplied out, a block with a batch of requests at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..plans.shared import kept

#: Rows of a block, about; cells; vectors sampled for the cells' centres; requests that meet a block, and centres that meet requests, at once.
BLOCK_ROWS, CELLS, SAMPLE, BATCH, CENTRES = 1024, 256, 4096, 512, 512
#: Blocks are stored in row groups of about this size.
GROUP_BYTES = 16 << 20
#: So many ids are broadcast at most.
BROADCAST_ROWS = 1_000_000
DIGITS = 6


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Vectors far from each other, then moved to the middle of what is nearest to them."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < cells and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen]
    for _ in range(4):
        owner = (-2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.array([sample[owner == k].mean(0) if (owner == k).any() else c for k, c in enumerate(centres)])
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls and with equal lengths as a matrix."""
    bounds = np.asarray(column.offsets)
    flat = np.asarray(column.values, float)[bounds[0] : bounds[-1]]
    return flat.reshape(len(column), -1)


def _members(flat: np.ndarray, lists: pa.ListArray, n: int) -> np.ndarray:
    """A row of n zeros and ones for each list: which numbers it holds."""
    out = np.zeros((len(lists), n), np.float32)
    out[np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), flat] = 1
    return out


@dataclass(frozen=True)
class VectorBlocks:
    spark: SparkSession
    path: str

    def append(self, vectors: DataFrame, name: str) -> None:
        """Adds rows (chunk_id, embedding) as the folder name; one that is there already is an error.

        Embeddings must be whole (vector_validate says which are) and of one length. Without rows an empty folder is written."""
        rows = vectors.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select("chunk_id", "embedding")
        rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
        single = rows.schema["embedding"].dataType.elementType == FloatType()
        kind = "<f4" if single else "<f8"  # products are of doubles either way
        # chunks of one vector share it: only ids and hashes move for all, vectors for one chunk of each
        named = kept(rows.select("chunk_id", "h1", "h2"))
        counts = kept(named.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")))
        chosen = counts.select("chunk_id")
        some = rows.join(F.broadcast(chosen) if counts.count() <= BROADCAST_ROWS else chosen, "chunk_id", "left_semi")
        distinct = kept(some.join(counts, ["h1", "h2", "chunk_id"]).dropDuplicates(["h1", "h2"]).select("h1", "h2", "n", "embedding"))
        sample = np.array([r.embedding for r in distinct.orderBy("h2", "h1").limit(SAMPLE).collect()], float)
        centres = _centres(sample, CELLS) if len(sample) else sample

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("embedding")) if batch.num_rows else np.zeros((0, 1))
                cell = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1) if batch.num_rows else np.empty(0, int)
                data = [v.tobytes() for v in x.astype(kind)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "n")), pa.array(cell, pa.int32()), pa.array(data, pa.binary())], names=["h1", "h2", "n", "cell", "data"])

        placed = kept(distinct.mapInArrow(dealt, "h1 long, h2 long, n long, cell int, data binary"))
        sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # a row for each cell
        parts = F.ceil((F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("cell")] if sizes else F.lit(1)) / BLOCK_ROWS)
        # chunks of a vector that more than a block has are dealt over several
        often = counts.where(F.col("n") > BLOCK_ROWS).select("h1", "h2", F.ceil(F.col("n") / BLOCK_ROWS).alias("k"))
        salt = F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("chunk_id"), "k")).otherwise(0)
        listed = named.join(often, ["h1", "h2"], "left").groupBy("h1", "h2", salt.alias("salt")).agg(F.collect_list("chunk_id").alias("ids"))
        full = listed.join(placed, ["h1", "h2"]).select("cell", F.pmod(F.xxhash64("h1", "h2", "salt"), parts).alias("part"), "ids", "data")

        def packed(t: pa.Table) -> pa.Table:
            lists = t.column("ids").combine_chunks()
            ids = lists.flatten().to_numpy()
            order = np.argsort(ids, kind="stable")
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[order]
            x = np.frombuffer(b"".join(t.column("data").to_pylist()), kind).reshape(len(lists), -1)
            centre = x.mean(0, dtype=float)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
            return pa.table({"block": [f"{name}/{t.column('cell')[0]}/{t.column('part')[0]}"], "centre": [centre.tolist()], "radius": [radius], "chunk_ids": [ids[order].tolist()], "vectors": pa.array([of.tolist()], pa.list_(pa.int32())), "data": [x.tobytes()]})

        blocks = full.groupBy("cell", "part").applyInArrow(packed, "block string, centre array<double>, radius double, chunk_ids array<long>, vectors array<int>, data binary")
        # a reader takes up to 4096 rows of a row group at once, and a row here is a whole matrix
        groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 4}
        blocks.write.mode("errorifexists").options(**groups).parquet(f"{self.path}/segment={name}")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("block string, centre array<double>, radius double, chunk_ids array<bigint>, vectors array<int>, data binary, segment string").parquet(self.path)

    def places(self) -> DataFrame:
        """(chunk_id, block, place) of all rows, read without the vectors."""
        return self.blocks().select("block", F.posexplode("chunk_ids").alias("place", "chunk_id"))

    def bounds(self, requests: DataFrame) -> DataFrame:
        """(request_id, block, low, high) for each request (request_id, embedding) and block, from centres alone."""
        lists = requests.select("request_id", F.col("embedding").cast("array<double>").alias("embedding"))
        centres = self.blocks().select("block", "centre", "radius")
        n = max(1, -(-centres.count() // CENTRES))
        grouped = centres.groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).alias("group")).agg(F.collect_list(F.struct("block", "centre", "radius")).alias("centres"))
        batches = max(1, -(-requests.count() // BATCH))
        asked = lists.groupBy(F.pmod(F.xxhash64("request_id"), F.lit(batches)).alias("batch")).agg(F.collect_list(F.struct("request_id", "embedding")).alias("requests"))
        met = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(grouped, "group")

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for requests, centres in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                    q, c = np.array([r["embedding"] for r in requests]), np.array([r["centre"] for r in centres])
                    middle = q @ c.T
                    reach = np.linalg.norm(q, axis=1)[:, None] * np.array([r["radius"] for r in centres])[None, :]
                    ids = np.repeat([r["request_id"] for r in requests], len(centres))
                    names = pa.array([r["block"] for r in centres]).take(pa.array(np.tile(np.arange(len(centres)), len(requests))))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), names, pa.array((middle - reach).ravel()), pa.array((middle + reach).ravel())], names=["request_id", "block", "low", "high"])

        return met.select("requests", "centres").mapInArrow(run, "request_id long, block string, low double, high double")

    def top_k(self, requests: DataFrame, live: DataFrame, may: DataFrame, k: int) -> DataFrame:
        """(request_id, chunk_id, score, rank): each request's k best rows by product, rounded, ties to the smaller id.

        requests: (request_id, embedding), ids not repeated; live: (block, place, unit) of rows that somebody may read; may:
        (request_id, unit), not repeated. A request with fewer readable rows gets them all; requests without an embedding none."""
        asked = kept(requests.where("embedding IS NOT NULL").select("request_id", F.col("embedding").cast("array<double>").alias("embedding")))
        units = kept(live.groupBy("block", "unit").agg(F.collect_list("place").alias("places")))
        sized = units.select("block", "unit", F.size("places").alias("n"))
        pairs = may.join(sized, "unit").groupBy("request_id", "block").agg(F.sum("n").alias("n"), F.collect_list("unit").alias("units"))
        bounded = pairs.join(self.bounds(asked), ["request_id", "block"])
        by_low = Window.partitionBy("request_id").orderBy(F.desc("low"), "block").rowsBetween(Window.unboundedPreceding, 0)
        enough = F.when(F.sum("n").over(by_low) >= k, F.col("low"))
        surely = F.max("enough").over(Window.partitionBy("request_id"))
        open_pairs = bounded.withColumn("enough", enough).withColumn("surely", surely).where(F.col("surely").isNull() | (F.col("high") >= F.col("surely") - 2 * 10.0**-DIGITS))
        batch = F.pmod(F.xxhash64("request_id"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("block")) / BATCH)))
        meeting = open_pairs.select("request_id", "block", "units", batch.alias("batch")).join(asked, "request_id")
        work = meeting.groupBy("block", "batch").agg(F.collect_list(F.struct("request_id", "embedding", "units")).alias("requests"))
        of_block = units.groupBy("block").agg(F.collect_list(F.struct("unit", "places")).alias("units"))
        ready = work.join(of_block, "block").join(self.blocks().select("block", "chunk_ids", "vectors", "centre", "data"), "block")

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for i in range(batch.num_rows):
                    requests, units = batch.column(0)[i].values, batch.column(1)[i].values
                    ids = batch.column(2)[i].values.to_numpy()
                    of, wide = batch.column(3)[i].values.to_numpy(), len(batch.column(4)[i])
                    data = batch.column(5)[i].as_buffer()
                    x = np.frombuffer(data, "<f4" if data.size == 4 * wide * (of.max() + 1) else "<f8").astype(float).reshape(-1, wide)
                    rows_of = _members(units.field("places").flatten().to_numpy(), units.field("places"), len(ids))
                    named = pc.index_in(requests.field("units").flatten(), value_set=units.field("unit")).to_numpy()
                    units_of = _members(named, requests.field("units"), len(units))
                    embeddings = requests.field("embedding").flatten().to_numpy().reshape(len(requests), -1)
                    score = np.round(embeddings @ x.T, DIGITS)[:, of] + 0.0
                    score[units_of @ rows_of == 0] = -np.inf
                    order = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids are sorted, so equal scores go by id
                    best = np.take_along_axis(score, order, 1)
                    row, col = np.nonzero(best > -np.inf)
                    names = requests.field("request_id").to_numpy()[row]
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids[order[row, col]]), pa.array(best[row, col])], names=["request_id", "chunk_id", "score"])

        found = ready.select("requests", "units", "chunk_ids", "vectors", "centre", "data").mapInArrow(run, "request_id long, chunk_id long, score double")
        rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "chunk_id")).cast("long")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
