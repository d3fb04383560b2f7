"""A stored inverted index: for each term, where it stands in which chunks.

A posting block holds one term and the chunks of one range of ids (BLOCK_IDS wide; a large range may have several rows), so a term that is in every chunk is spread
over many blocks and tasks, and two terms' blocks of one range meet by equal keys. A row has the block's counts first, which are
all that choosing blocks needs, then the payload: chunk ids, how often the term stands in each, and its places, each as the step
from the one before. Rows are filed by a hash of the term (shard) and sorted by term, so that a reader opens the shards of its
terms and skips the row groups of others. Each append is a folder of its own that never changes; the reader takes all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import kept
from .analysis import Segmenter, tokenize, words

#: Ids of chunks are cut in ranges of this width.
BLOCK_IDS = 1 << 18
#: A row of the index. Terms that are sorted at once.
ROW = "term string, block long, n int, most int, chunk_steps array<int>, counts array<int>, place_steps array<int>"
MOST_TERMS = 1 << 20
#: Requests that meet a range's postings at once.
BATCH = 1024
SHARDS = 16


def _shard(term: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _rows_of_range(block: int, ids: np.ndarray, sizes: np.ndarray, found: list[str]) -> pa.RecordBatch:
    """Posting rows of chunks of one range, ids rising: found has their texts' terms end to end, sizes how many each text has. Texts of
    one id are one chunk, and the places of a term in them one list."""
    named = pa.array(found, pa.string()).dictionary_encode()
    code = named.indices.to_numpy()
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    of = np.repeat(np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ids)))), sizes)
    place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable") if len(begin) == len(ids) else np.lexsort((place, of, code))
    ids, code, of, place = ids[begin], code[order], of[order], place[order]
    new_term = np.append(True, code[1:] != code[:-1])
    new = new_term | np.append(True, of[1:] != of[:-1])
    start = np.flatnonzero(new)
    counts = np.diff(np.append(start, len(code)))
    chunk, first = ids[of[start]] - block * BLOCK_IDS, np.flatnonzero(new_term[start])
    chunk_steps, place_steps = np.diff(chunk, prepend=0), np.diff(place, prepend=0)
    chunk_steps[first], place_steps[new] = chunk[first], place[new]
    held = np.append(first, len(start)).astype(np.int32)
    occurrences = np.append(start[first], len(code)).astype(np.int32)
    lists = lambda bounds, values, kind: pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
    columns = [named.dictionary, pa.array(np.full(len(first), block)), pa.array(np.diff(held), pa.int32()), pa.array(np.maximum.reduceat(counts, first), pa.int32()), lists(held, chunk_steps, pa.int32()), lists(held, counts, pa.int32()), lists(occurrences, place_steps, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROW.split(", ")])


def _posted(segment: Segmenter):
    """Posting rows of chunks (chunk_id, text) in order of their ids: a range's terms are numbered and sorted at once, and so are
    MOST_TERMS of them at a time, if there are more; a term has more rows of that range then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, found = None, [], [], []
        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = tokenize(text.as_py(), segment) if text.is_valid else []
                if found and (chunk // BLOCK_IDS != block or len(found) + len(own) > MOST_TERMS and chunk != ids[-1]):
                    yield _rows_of_range(block, np.array(ids), np.array(sizes), found)
                    ids, sizes, found = [], [], []
                if own:
                    block = chunk // BLOCK_IDS
                    ids.append(chunk)
                    sizes.append(len(own))
                    found += own
        if found:
            yield _rows_of_range(block, np.array(ids), np.array(sizes), found)

    return run


def _sums(steps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums in each list of a column, laid end to end, and the lists' bounds."""
    bounds = np.asarray(steps.offsets)
    flat = np.asarray(steps.values)[bounds[0] : bounds[-1]].astype(np.int64)
    bounds = bounds - bounds[0]
    total = np.concatenate([[0], np.cumsum(flat)])
    return total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds)), bounds


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, block, chunk_steps, counts, place_steps = (batch.column(k) for k in range(5))
        chunks, bounds = _sums(chunk_steps)
        of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        chunks = chunks + np.asarray(block)[of] * BLOCK_IDS
        n = np.asarray(counts.values)[counts.offsets[0].as_py() : counts.offsets[-1].as_py()]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = np.asarray(place_steps.values)[place_steps.offsets[0].as_py() : place_steps.offsets[-1].as_py()]
        places, _ = _sums(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        yield pa.RecordBatch.from_arrays([term.take(pa.array(of)), pa.array(chunks, pa.int64()), block.take(pa.array(of)), listed], names=["term", "chunk_id", "block", "places"])


class Posted:
    """The postings of one range of ids, a term's decoded when it is first asked for: sorted chunk ids, and where their places lie."""

    def __init__(self, block: int, rows: pa.StructArray):
        self.start = block * BLOCK_IDS
        self.rows: dict[str, list[int]] = {}
        for k, term in enumerate(rows.field("term").to_pylist()):
            self.rows.setdefault(term, []).append(k)
        self.chunk_steps, self.counts, self.place_steps = rows.field("chunk_steps"), rows.field("counts"), rows.field("place_steps")
        self.done: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk ids in order, and for each the bounds of its places in the third array."""
        if term not in self.done:
            chunks, counts, places = [], [], []
            for k in self.rows[term]:  # one or more for each append
                chunks.append(self.start + np.cumsum(self.chunk_steps[k].values.to_numpy()))
                n = self.counts[k].values.to_numpy()
                total = np.concatenate([[0], np.cumsum(self.place_steps[k].values.to_numpy())])
                places.append(total[1:] - np.repeat(total[np.cumsum(n) - n], n))
                counts.append(n)
            order = np.argsort(all_chunks := np.concatenate(chunks), kind="stable")
            n = np.concatenate(counts)
            ends = np.cumsum(n)
            self.done[term] = all_chunks[order], np.stack([ends - n, ends])[:, order], np.concatenate(places)
        return self.done[term]


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each request the chunks that all of its terms have, and the places of each term in them."""
    for batch in batches:
        request, chunk, places = [], [], []
        for i in range(batch.num_rows):
            posted = Posted(batch.column(0)[i].as_py(), batch.column(2)[i].values)
            for asking in batch.column(1)[i].as_py():
                terms = asking["terms"]  # the rarest first
                common = posted.of(terms[0])[0]
                for term in terms[1:]:
                    other = posted.of(term)[0]
                    common = common[other[np.minimum(np.searchsorted(other, common), len(other) - 1)] == common]
                    if not len(common):
                        break
                if not len(common):
                    continue
                request += [asking["request_id"]] * len(common)
                chunk += common.tolist()
                found = []
                for term in terms:
                    chunks, bounds, flat = posted.of(term)
                    low, high = bounds[:, np.searchsorted(chunks, common)]
                    found.append([flat[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                places += map(list, zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(request, pa.int64()), pa.array(chunk, pa.int64()), pa.array(places, pa.list_(pa.list_(pa.int32())))], names=["request_id", "chunk_id", "places"])


@dataclass(frozen=True)
class Postings:
    """The index in a folder that all executors share."""

    spark: SparkSession
    path: str
    shards: int = SHARDS

    def append(self, chunks: DataFrame, name: str, segment: Segmenter = words) -> None:
        """Adds chunks (chunk_id, text) that the index hasn't yet, as the folder name; one that is there already is an error.

        Null and empty texts have no terms, null ids are left out, rows of one id are texts of one chunk, each with places from 0 on.
        Extra columns are ignored."""
        self.filed(chunks, segment).write.mode("errorifexists").partitionBy("shard").parquet(f"{self.path}/segment={name}")

    def filed(self, chunks: DataFrame, segment: Segmenter = words) -> DataFrame:
        """Rows of the index by shard and term. Texts move once, to the ranges of their ids, and nothing after that: each range's rows
        are filed where they are made."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # by number, as texts are small beside the work on them
        ranged = chunks.where("chunk_id IS NOT NULL").select("chunk_id", "text").repartition(parts, F.floor(F.col("chunk_id") / BLOCK_IDS)).sortWithinPartitions("chunk_id")
        return ranged.mapInArrow(_posted(segment), ROW).withColumn("shard", _shard("term", self.shards)).sortWithinPartitions("shard", "term", "block")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{ROW}, segment string, shard int").parquet(self.path)

    def heads(self, asked: DataFrame) -> DataFrame:
        """(term, block, n, most) of asked terms (term): sums over appends, read without payload from the shards of these terms."""
        named = asked.select("term").distinct().withColumn("shard", _shard("term", self.shards))
        shards = [r.shard for r in named.select("shard").distinct().collect()]  # at most as many as there are shards
        mine = self.blocks().where(F.col("shard").isin(shards)).join(named, ["shard", "term"], "left_semi")
        return mine.groupBy("term", "block").agg(F.sum("n").cast("long").alias("n"), F.max("most").alias("most"))

    def decode(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, chunk_id, block, places) of blocks named in wanted (term, block), or of all."""
        rows = self.blocks()
        if wanted is not None:
            rows = rows.join(wanted.select("term", "block", _shard("term", self.shards).alias("shard")).distinct(), ["shard", "term", "block"], "left_semi")
        return rows.select("term", "block", "chunk_steps", "counts", "place_steps").mapInArrow(_decoded, "term string, chunk_id long, block long, places array<int>")

    def match(self, asked: DataFrame, least: float = 0.0) -> DataFrame:
        """(request_id, chunk_id, places) of chunks that hold all terms of a request; places: an array for each term.

        asked has distinct (request_id, term). A request without terms, or with a term that is nowhere, matches nothing. Blocks
        are chosen by their heads alone: those of a request's rarest term in which all other terms have a block, too. A chunk's
        cover density is at most the number of terms times the occurrences of the term that stands there least often, so a block
        whose greatest counts can't reach `least` isn't read."""
        asked = kept(asked.select("request_id", "term"))
        heads = kept(self.heads(asked))
        of_term = heads.groupBy("term").agg(F.sum("n").alias("held"))
        sized = asked.select("request_id", "term").join(of_term, "term", "left")
        by_request = Window.partitionBy("request_id")
        ranked = sized.select("request_id", "term", F.count("*").over(by_request).alias("n_terms"), F.count("held").over(by_request).alias("found"), F.row_number().over(by_request.orderBy(F.coalesce("held", F.lit(0)), "term")).alias("place"))
        known = kept(ranked.where("found = n_terms"))
        rarest = known.where("place = 1").select("request_id", "term", "n_terms")
        near = rarest.join(heads.select("term", "block"), "term").select("request_id", "block", "n_terms")
        whole = near.join(known.select("request_id", "term"), "request_id").join(heads.select("term", "block", "most"), ["term", "block"])
        open_blocks = whole.groupBy("request_id", "block", "n_terms").agg(F.count("*").alias("met"), F.min("most").alias("most")).where((F.col("met") == F.col("n_terms")) & (F.col("n_terms") * F.col("most") >= least))
        listed = known.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "term")))["term"].alias("terms"))
        work = kept(open_blocks.select("request_id", "block").join(listed, "request_id"))
        needed = work.select(F.explode("terms").alias("term"), "block").distinct().withColumn("shard", _shard("term", self.shards))
        # a range's postings move once, whoever asks for them; requests meet them in batches
        posted = self.blocks().join(needed, ["shard", "term", "block"], "left_semi").groupBy("block").agg(F.collect_list(F.struct("term", "chunk_steps", "counts", "place_steps")).alias("posted"))
        batch = F.floor((F.row_number().over(Window.partitionBy("block").orderBy("request_id")) - 1) / BATCH).alias("batch")
        asking = work.select("block", batch, F.struct("request_id", "terms").alias("request")).groupBy("block", "batch").agg(F.collect_list("request").alias("requests"))
        return asking.join(posted, "block").select("block", "requests", "posted").mapInArrow(_intersected, "request_id long, chunk_id long, places array<array<int>>")
