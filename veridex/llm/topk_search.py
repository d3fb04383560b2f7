"""Exact top-k search by inner product with two trees.

Vectors become integers, floor(1024 * x). Rows are dealt into cells around a bounded sample of vectors and cells into blocks of
bounded size. In a task, one tree covers the rows of a block and another a group of queries: every node has a centre and the
radius that covers its points. A pair of nodes whose best possible product lies below the worst kth score of the queries in it
is left out with all below; other pairs are taken apart down to leaves, which are multiplied out. First each query meets its
own block, which gives its kth score; then groups of queries meet all blocks.

Rows with a null id or vector, or a null or non-finite component, take no part; a query meets only vectors of its length.
Repeated rows are candidates of their own, each with a rank. Query rows that are equal count once; of query rows that share an id
but not a vector, the id's ranks hold the best scores of all. No row with a query's own id is its result. Ties go to the smaller id. Scores are exact integers: products that doubles can't hold exactly are
multiplied out in longs, and those beyond longs in Python's integers, clipped to a long in the end; components are clipped to
2**62. An empty table gives no rows. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

SCALE = 1024
#: Cells are around so many sampled vectors at most.
CELLS = 64
BLOCK_ROWS, GROUP_QUERIES, LEAF, FAN_OUT = 2048, 1024, 48, 6
LOWEST = -(1 << 63) + 1


class Tree:
    """Nodes in arrays; the points of a node are perm[begin:end]."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(float)
        self.largest = int(np.abs(x).max(initial=0))
        self.perm = np.arange(len(x))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.range: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._build(0, len(x))
        self.norm = [float(np.linalg.norm(c)) for c in self.centre]

    def _build(self, begin: int, end: int) -> int:
        points = self.x[self.perm[begin:end]]
        middle = points.mean(0)
        far = np.sqrt(((points - middle) ** 2).sum(1).max())
        node = len(self.centre)
        self.centre.append(middle)
        self.radius.append(float(far))
        self.range.append((begin, end))
        self.children.append([])
        if end - begin <= LEAF or far == 0:
            return node
        # children around points far from each other
        near = ((points - middle) ** 2).sum(1)
        seeds, best, owner = [], np.full(len(points), np.inf), np.zeros(len(points), int)
        for k in range(FAN_OUT):
            s = int(near.argmax() if k == 0 else best.argmax())
            if k and best[s] == 0:
                break
            seeds.append(s)
            d = ((points - points[s]) ** 2).sum(1)
            owner[d < best] = k
            best = np.minimum(best, d)
        order = np.argsort(owner, kind="stable")
        self.perm[begin:end] = self.perm[begin:end][order]
        sizes = np.bincount(owner, minlength=len(seeds))
        if len(seeds) < 2:
            return node
        at = begin
        for n in sizes.tolist():
            if n:
                self.children[node].append(self._build(at, at + n))
                at += n
        return node


def products(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of whole numbers; most bounds their size."""
    if most < 1 << 53:
        return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 1 << 63:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), LOWEST + 1, (1 << 63) - 1).astype(np.int64)


def best_products(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best in x, but for those below floor."""
    a, b = Tree(q), Tree(x)
    score = np.full((len(q), k), LOWEST)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    worst = floor.astype(np.int64)
    most_possible = a.largest * b.largest * q.shape[1]

    def bound(i: int, j: int) -> float:
        # what doubles may lose in the sums is far below a share of 1e-9 of the sizes
        return float(a.centre[i] @ b.centre[j]) + a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j] + 1e-9 * (a.norm[i] + a.radius[i]) * (b.norm[j] + b.radius[j]) + 1e-3

    todo = [(bound(0, 0), 0, 0)]
    while todo:
        most, i, j = todo.pop()
        mine = a.perm[slice(*a.range[i])]
        if most < worst[mine].min():
            continue
        if a.children[i] or b.children[j]:
            left = a.children[i] if a.children[i] and (not b.children[j] or a.radius[i] >= b.radius[j]) else [i]
            right = b.children[j] if left == [i] else [j]
            todo += sorted((bound(c, d), c, d) for c in left for d in right)  # the most promising pair comes off first
            continue
        theirs = b.perm[slice(*b.range[j])]
        s = products(q[mine], x[theirs], most_possible)
        s[q_ids[mine][:, None] == x_ids[theirs][None, :]] = LOWEST
        some = np.flatnonzero((s >= worst[mine][:, None]).any(1))
        if not len(some):
            continue
        rows = mine[some]
        both = np.concatenate([score[rows], s[some]], 1)
        names = np.concatenate([ids[rows], np.broadcast_to(x_ids[theirs], (len(some), len(theirs)))], 1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        score[rows] = np.take_along_axis(both, order, 1)
        ids[rows] = np.take_along_axis(names, order, 1)
        worst[rows] = np.maximum(worst[rows], score[rows, -1])
    row, col = np.nonzero((score > LOWEST) & (score >= floor[:, None]))
    return row, ids[row, col], score[row, col]


def _matrix(items: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([np.frombuffer(r["data"], np.int64) for r in items]), np.array([r["id"] for r in items], np.int64)


def _search(k: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for queries, rows in zip(batch.column("queries"), batch.column("rows"), strict=True):
            queries, rows = queries.as_py(), rows.as_py()
            q, q_ids = _matrix(queries)
            x, x_ids = _matrix(rows)
            row, ids, score = best_products(q, q_ids, np.array([r["floor"] for r in queries], np.int64), x, x_ids, k)
            yield {"query_id": q_ids[row], "vec_id": ids, "score": score}

    return run


RESULT = "query_id long, vec_id long, score long"


def _quantised(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("id", "dim", "cell", "data")}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.clip(np.floor(SCALE * np.array(v, float)), -(2.0**62), 2.0**62).astype(np.int64)
            c = centres.get(len(x))
            out["id"].append(i)
            out["dim"].append(len(x))
            out["cell"].append(int(((c - x) ** 2).sum(1).argmin()) if c is not None else 0)
            out["data"].append(x.tobytes())
        yield out

    return map_arrow(vectors, run, "id long, dim int, cell int, data binary")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own; is_query is a condition on the column id."""
    whole = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)
    good = vectors.where(whole).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sample: dict[int, list] = {}
    for r in good.orderBy(F.xxhash64("id")).limit(4 * CELLS).collect():
        sample.setdefault(len(r["v"]), []).append(np.floor(SCALE * np.array(r["v"])))
    centres = {n: np.unique(np.array(c), axis=0)[:: max(1, -(-len(c) // CELLS))] for n, c in sample.items()}
    rows = cut(_quantised(good, centres))
    sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    rows = cut(rows.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS))))
    block = ["dim", "cell", "part"]
    item = F.struct("id", "data")
    blocks = cut(rows.groupBy(block).agg(F.collect_list(item).alias("rows")))
    queries = rows.where(is_query).dropDuplicates(["id", "data"]).withColumn("floor", F.lit(LOWEST))
    with_floor = F.struct("id", "data", "floor")
    own = queries.groupBy(block).agg(F.collect_list(with_floor).alias("queries")).join(blocks, block)
    first = map_arrow(own.select("queries", "rows").repartition(F.xxhash64(F.col("queries")[0]["id"])), _search(k), RESULT)
    kth = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("found")).where(F.col("found") >= k).select(F.col("query_id").alias("id"), "floor")
    ready = cut(queries.drop("floor").join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST))))
    # groups hold queries of neighbouring cells; a large cell has groups of its own
    n_groups = F.greatest(F.lit(1), F.ceil(F.lit(ready.count()) / GROUP_QUERIES)).cast("int")
    ready = ready.withColumn("group", F.struct((F.col("cell") * n_groups / F.lit(CELLS + 1)).cast("int").alias("a"), F.pmod(F.xxhash64("id"), F.ceil(F.col("q") / GROUP_QUERIES)).alias("b")))
    groups = cut(ready.groupBy("dim", "group").agg(F.collect_list(with_floor).alias("queries")))
    of_dim = groups.groupBy("dim").agg(F.collect_list("group").alias("groups"))
    met = blocks.join(of_dim, "dim").select("dim", "cell", "part", "rows", F.explode("groups").alias("group")).join(groups, ["dim", "group"])
    found = map_arrow(met.repartition("dim", "group", "cell", "part").select("queries", "rows"), _search(k), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) q JOIN v x ON x.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""
