"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are dealt evenly into shards of bounded size. Several islands breed packings of each shard; between epochs
every island gets the best packing of its neighbour. Crossover puts whole well-filled bins of one parent into the other,
drops the bins that then hold duplicates, and re-inserts their other documents by best fit. Poorly filled bins of all
shards are dealt anew and packed once more, so that shards cost next to nothing in sequences.

Null and empty texts are one piece that holds only the end id. Repeated rows and ids are packed as rows of their own. An
empty table gives no rows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import cut, map_arrow, strings, table, text_groups

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every row: the ids and an end id; more than capacity are cut, the first piece being the shorter one."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        e, texts = encoder(path), strings(batch.column(1))
        for a, b in text_groups(texts, 4 << 20):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(batch.column(0)[a:b].to_pylist(), e.encode(texts[a:b]), strict=True):
                data = np.append(ids, end_id).astype("<u4")
                cuts = [0, *range(len(data) % capacity or capacity, len(data), capacity), len(data)]
                for k, (s, t) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, x in zip(out, (doc_id, k, s, t - s, zlib.crc32(data[s:t].tobytes())), strict=True):
                        out[name].append(x)
            yield out

    return map_arrow(docs.select("doc_id", "text"), run, PIECE)


def best_fit(sizes: list[int], order: list[int], bins: list[list[int]], room: list[int]) -> None:
    """Puts the items, in this order, each into the fullest bin that still takes it; capacity is that of a new bin."""
    free = sorted((r, k) for k, r in enumerate(room[:-1]))
    capacity = room[-1]
    del room[-1]
    for i in order:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
        else:
            r, k = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[k] = r - sizes[i]
        insort(free, (room[k], k))


class Island:
    """Breeds packings of one shard."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, np.random.default_rng(seed)
        self.bound = -(-sum(sizes) // capacity)

    def insert(self, items: np.ndarray, bins: list[list[int]], noise: float) -> list[list[int]]:
        keys = np.array([self.sizes[i] for i in items], float)
        if noise:
            keys *= self.rng.uniform(1 - noise, 1, len(keys))
        room = [self.capacity - sum(self.sizes[i] for i in b) for b in bins]
        best_fit(self.sizes, [int(x) for x in np.asarray(items)[np.argsort(-keys, kind="stable")]], bins, [*room, self.capacity])
        return bins

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        return len(bins), -sum((sum(self.sizes[i] for i in b) / self.capacity) ** 2 for b in bins)

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        fill = np.array([sum(self.sizes[i] for i in x) for x in b])
        chosen = [b[k] for k in np.flatnonzero(fill >= np.quantile(fill, self.rng.uniform(0.3, 0.9)))]
        taken = {i for x in chosen for i in x}
        kept = [x for x in a if not taken.intersection(x)]
        if kept:  # a mutation: the emptiest bins go too
            kept.sort(key=lambda x: -sum(self.sizes[i] for i in x))
            kept = kept[: max(1, len(kept) - int(self.rng.integers(1, 4)))]
        here = taken.union(*kept) if kept else taken
        loose = np.array([i for i in range(len(self.sizes)) if i not in here], int)
        return self.insert(loose, [list(x) for x in chosen] + [list(x) for x in kept], 0.1)

    def evolve(self, elites: list[list[list[int]]], population: int, generations: int) -> list[list[int]]:
        everyone = np.arange(len(self.sizes))
        best = min([*elites, self.insert(everyone, [], 0.0)], key=self.fitness)
        if len(best) <= self.bound:
            return best
        people = [*elites, best] + [self.insert(everyone, [], 0.3) for _ in range(population - 1)]
        for _ in range(generations):
            people.sort(key=self.fitness)
            if len(people[0]) <= self.bound:
                break
            people = people[:population]
            i, j = self.rng.integers(0, len(people), 2)
            people += [self.cross(people[0], people[i]), self.cross(people[i], people[j])]
        return min(people, key=self.fitness)


def pack(items: DataFrame, capacity: int, shard_items: int = 2000, islands: int = 2, epochs: int = 2, population: int = 5, generations: int = 6) -> DataFrame:
    """(shard, bin, place in the bin, the item's row) for items with uid and length <= capacity; items come materialised."""
    n = items.count()
    rows = [c for c in items.columns if c != "shard"]
    shards = items.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-n // shard_items)))).cast("long"))
    shards = shards.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "uid", *[c for c in rows if c not in ("length", "uid")]))).alias("items"))
    pool = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.array().cast("array<array<int>>"))
    pool = pool.withColumn("lengths", F.col("items.length"))
    schema = f"shard long, items {pool.schema['items'].dataType.simpleString()}, lengths array<long>, island int, bins array<int>, n_bins int"

    def breed(epoch: int):
        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            of, n_bins = [], []
            for shard, sizes, island, elites in zip(*(batch.column(c).to_pylist() for c in ("shard", "lengths", "island", "elites")), strict=True):
                groups = []
                for e in elites:
                    bins: dict[int, list[int]] = {}
                    for i, k in enumerate(e):
                        bins.setdefault(k, []).append(i)
                    groups.append(list(bins.values()))
                found = Island(sizes, capacity, (shard * islands + island) * epochs + epoch).evolve(groups, population, generations)
                place = np.zeros(len(sizes), np.int32)
                for k, b in enumerate(found):
                    place[b] = k
                of.append(place)
                n_bins.append(len(found))
            yield {c: batch.column(c) for c in ("shard", "items", "lengths", "island")} | {"bins": of, "n_bins": n_bins}

        return run

    for epoch in range(epochs):
        # a shard's islands are few thousand numbers each; they are dealt out so that breeding runs everywhere
        pool = cut(map_arrow(pool.repartition("shard", "island"), breed(epoch), schema))
        if epoch + 1 < epochs:
            elite = pool.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("bins").alias("guest"))
            pool = pool.join(elite, ["shard", "island"]).select("shard", "items", "lengths", "island", F.array("bins", "guest").alias("elites"))
    best = pool.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"), F.min_by("items", F.struct("n_bins", "island")).alias("items"))
    each = best.select("shard", F.inline(F.arrays_zip("items", "bins"))).select("shard", F.col("bins").alias("bin"), "items.*")
    return each.select("shard", "bin", *rows)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, loose_below: float = 0.97) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = cut(token_pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    packed = cut(pack(pieces.where(F.col("length") < capacity), capacity))
    fill = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    # each shard's few emptiest bins are opened again and their pieces packed over all shards
    loose = packed.join(fill.where(F.col("fill") < loose_below * capacity), ["shard", "bin"], "left_semi")
    again = pack(cut(loose.drop("shard", "bin")), capacity)
    first = packed.join(fill.where(F.col("fill") >= loose_below * capacity), ["shard", "bin"], "left_semi").withColumn("round", F.lit(0))
    both = first.unionByName(again.withColumn("round", F.lit(1)))
    # shard, round and bin make one number: a shard has fewer than 2**20 bins
    both = both.withColumn("sequence_id", F.shiftleft(F.col("shard"), 21) + F.shiftleft(F.col("round").cast("long"), 20) + F.col("bin"))
    from pyspark.sql import Window

    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("uid")) - F.col("length")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return both.withColumn("offset", before).select(columns).unionByName(full.select(columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
