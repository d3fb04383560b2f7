"""The analyser, the stored postings and the vector blocks against plain readings."""

import os
import random
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridex.operators import analysis, postings
from veridex.operators.analysis import terms, tokenize, words
from veridex.operators.covers import cover_score
from veridex.operators.postings import Postings
from veridex.operators.search import stored_index
from veridex.operators.vectors import VectorBlocks
from veridex.plans.run import Tables


@pytest.mark.parametrize(
    "text, want",
    [("ＡＢＣ１２３", ["abc123"]), ("STRASSE", ["strasse"]), ("straße", ["strasse"]), ("ERR_Code gpt-4 v1.2 c++ a&b", ["err_code", "gpt-4", "v1.2", "c", "a&b"]), ("数据库　ＡＢＣ", ["数据库", "abc"]), ("数据库 ABC", ["数据库", "abc"]), ("für x", ["f", "ü", "r", "x"]), ("🙂 … __ -", []), ("a a", ["a", "a"]), ("", [])],
)
def test_tokenize(text, want):
    assert tokenize(text) == want


def test_segmenter_of_the_user(spark):
    pairs = lambda text: [text[k : k + 2] for k in range(0, len(text), 2)]
    df = spark.createDataFrame([("数据库系 gpt-4。。",), (None,)], "text string")
    assert [r.t for r in df.select(terms("text", pairs).alias("t")).collect()] == [["数据", "库系", "gpt-4"], []]


def folder():
    return tempfile.mkdtemp(prefix="veridex-test-")


def texts(rng, n, first):
    return [(first + k * 7001, " ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 30)))) for k in range(n)]


def test_postings_keep_places_and_grow_by_appends(spark):
    rng = random.Random(1)
    index = Postings(spark, folder(), shards=3)
    parts = [texts(rng, 150, 0), texts(rng, 100, 3_000_000) + [(5, None), (6, "")]]
    schema = "chunk_id long, text string, term string"
    for k, part in enumerate(parts):
        index.append(spark.createDataFrame([(*r, "clash") for r in part], schema), f"part{k}")
    want = {}
    for chunk, text in parts[0] + parts[1]:
        for place, term in enumerate((text or "").split()):
            want.setdefault((term, chunk), []).append(place)
    assert {(r.term, r.chunk_id): r.places for r in index.decode().collect()} == want
    heads = index.heads(spark.createDataFrame([("a",), ("bb",), ("no",)], "term string")).groupBy("term").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    assert {r.term: (r.n, r.most) for r in heads.collect()} == {t: (sum(x == t for x, _ in want), max(len(v) for (x, _), v in want.items() if x == t)) for t in ("a", "bb")}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index.append(spark.createDataFrame(parts[0], "chunk_id long, text string"), "part0")
    asked = {1: ["a"], 2: ["a", "b", "cc"], 3: ["a", "no"], 4: ["dd", "e", "f", "g"], 5: ["bb", "hh"]}
    found = index.match(spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "request_id long, term string"))
    got = {(r.request_id, r.chunk_id): sorted(map(tuple, r.places)) for r in found.collect()}
    chunks = {c for _, c in want}
    assert got == {(q, c): sorted(tuple(want[t, c]) for t in ts) for q, ts in asked.items() for c in chunks if all((t, c) in want for t in ts)}


def test_covers_of_many_occurrences(spark):
    """Ten thousand places of two terms in one chunk, one after another: each neighbouring pair is a cover."""
    df = spark.createDataFrame([([list(range(0, 10_000, 2)), list(range(1, 10_000, 2))],), ([[3], [], [4]],), ([],)], "p array<array<int>>")
    assert [tuple(r) for r in df.select(cover_score("p").alias("s")).select("s.*").collect()] == [(9999, 9999.0), (0, 0.0), (0, 0.0)]


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_vectors_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8))
    x = np.round(np.repeat(centres, 60, axis=0) + spread * rng.normal(size=(1800, 8)), 3)
    x[100:140] = x[99]  # ties go to smaller ids
    blocks = VectorBlocks(spark, folder())
    half = len(x) // 2
    for name, part in (("one", range(half)), ("two", range(half, len(x)))):
        blocks.append(spark.createDataFrame([(int(k), x[k].tolist()) for k in part], "chunk_id long, embedding array<double>"), name)
    units = [k % 5 for k in range(len(x))]
    live = blocks.places().select("block", "place", (F.col("chunk_id") % 5).alias("unit"))
    q = np.round(centres[:12] + 0.01, 3)
    may = {k: {u for u in range(5) if (u + k) % 3} for k in range(12)} | {3: set(), 4: {0}}
    requests = spark.createDataFrame([(k, q[k].tolist()) for k in range(12)] + [(99, None)], "request_id long, embedding array<double>")
    got = blocks.top_k(requests, live, spark.createDataFrame([(k, u) for k, us in may.items() for u in us], "request_id long, unit long"), 20)
    want = []
    for k in range(12):
        scored = sorted((-np.round(q[k] @ x[i], 6), i) for i in range(len(x)) if units[i] in may[k])[:20]
        want += [(k, i, round(-s, 6), n) for n, (s, i) in enumerate(scored, 1)]
    assert sorted((r.request_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in got.collect()) == sorted(want)


def test_bounds_hold_and_leave_out_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + 0.01 * rng.normal(size=(2000, 16))
    blocks = VectorBlocks(spark, folder())
    blocks.append(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<double>"), "all")
    q = x[::400]
    bounds = blocks.bounds(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "request_id long, embedding array<double>")).collect()
    members = {}
    for r in blocks.places().collect():
        members.setdefault(r.block, []).append(r.chunk_id)
    assert len(bounds) == len(q) * len(members) > 0
    left_out = 0
    for b in bounds:
        s = x[members[b.block]] @ q[b.request_id]
        assert b.low - 1e-9 <= s.min() and s.max() <= b.high + 1e-9
        left_out += b.high < np.sort(x @ q[b.request_id])[-20]
    assert left_out > len(bounds) / 2


def test_few_vector_blocks_are_read_at_once(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr("veridex.operators.vectors.GROUP_BYTES", 1 << 16)
    rows = spark.range(40_000).select(F.col("id").alias("chunk_id"), F.array(*[F.rand(i).cast("float") for i in range(16)]).alias("embedding"))
    VectorBlocks(spark, str(tmp_path / "v")).append(rows, "a")
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "v").rglob("*.parquet")]
    assert max(m.num_rows for m in files) > 8
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 8


def test_chunks_are_cut_where_their_texts_are(spark):
    chunk = Tables(spark, "/root/testdata/sf0.001")["chunk"]
    assert "Exchange" not in chunk._jdf.queryExecution().executedPlan().toString()


def test_a_range_with_many_terms_has_several_rows(monkeypatch):
    monkeypatch.setattr(postings, "MOST_TERMS", 4)
    chunks = [(1, "a b a"), (2, "b c"), (4, ""), (5, None), (postings.BLOCK_IDS + 3, "a")]
    batches = [pa.RecordBatch.from_arrays([pa.array([c for c, _ in part]), pa.array([t for _, t in part], pa.string())], names=["chunk_id", "text"]) for part in (chunks[:1], chunks[1:])]
    rows = [r for b in postings._posted(words)(iter(batches)) for r in b.to_pylist()]
    assert [(r["term"], r["block"], r["n"], r["most"]) for r in rows] == [("a", 0, 1, 2), ("b", 0, 1, 1), ("b", 0, 1, 1), ("c", 0, 1, 1), ("a", 1, 1, 1)]
    assert (rows[0]["chunk_steps"], rows[0]["counts"], rows[0]["place_steps"]) == ([1], [2], [0, 2])
    assert [r["chunk_steps"] for r in rows] == [[1], [1], [2], [2], [3]]


def test_only_the_parts_that_a_query_reads_are_built(spark, tmp_path):
    for name in ("documents", "embeddings", "nation", "customer", "benchmark", "conversations"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    tables = Tables(spark, str(tmp_path))
    path = stored_index(tables, "chunks").path.replace("file:", "")
    assert sorted(os.listdir(path)) == ["chunks"]
    assert stored_index(tables, "chunks", "vectors").path.replace("file:", "") == path
    assert sorted(os.listdir(path)) == ["chunks", "vectors"]


def test_few_texts_terms_are_in_python_at_once(monkeypatch):
    monkeypatch.setattr(analysis, "AT_ONCE", 2)
    texts = pa.array(["a b", None, "", "ü c-1", "d"]).slice(1)
    assert analysis.listed(texts).to_pylist() == [[], [], ["ü", "c-1"], ["d"]]


def test_canaries_read_lines_once(spark):
    plan = Tables(spark, "/root/testdata/sf0.001")["canary_found"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_texts_of_one_chunk_id_are_one_chunk(spark, tmp_path):
    """A document of more than a thousand lines reaches the chunk ids of the next one."""
    import duckdb

    from veridex import registry

    shutil.copy("/root/testdata/sf0.001/embeddings.parquet", tmp_path)
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT 6 AS doc_id, string_agg(concat('w', i % 7, ' b w', i % 5), chr(10) ORDER BY i) AS text FROM range(1100) t(i) UNION ALL SELECT 7, concat('b w1', chr(10), 'c b b', chr(10), 'w3')) TO '{tmp_path}/documents.parquet'""")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = registry.QUERIES["keyword_postings"](spark, str(tmp_path)).select("term", "chunk_id", "tf", "positions").collect()
    want = con.sql(f"SELECT term, chunk_id, tf, positions FROM ({registry.ORACLES['keyword_postings']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert ("b", 7001, 3, "1,1,2") in map(tuple, got)


def test_only_texts_move_when_postings_are_made(spark, tmp_path):
    rows = Postings(spark, str(tmp_path)).filed(spark.createDataFrame([(1, "a b")], "chunk_id long, text string"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_equal_vectors_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("veridex.operators.vectors.BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20, 8)).astype(np.float32)
    of = np.append(rng.integers(0, 20, 900), np.zeros(600, int))
    blocks = VectorBlocks(spark, str(tmp_path / "v"))
    blocks.append(spark.createDataFrame([(k, x[v].tolist()) for k, v in enumerate(of.tolist())], "chunk_id long, embedding array<float>"), "a")
    stored = blocks.blocks().collect()
    assert sorted(c for r in stored for c in r.chunk_ids) == list(range(len(of)))
    assert sum(len(r.data) for r in stored) < 60 * 8 * 4  # a vector of more than 64 chunks stands in several blocks
    assert max(len(r.chunk_ids) for r in stored) < 600
    live = blocks.places().select("block", "place", F.lit(0).alias("unit"))
    got = blocks.top_k(spark.createDataFrame([(5, x[0].tolist())], "request_id long, embedding array<float>"), live, spark.createDataFrame([(5, 0)], "request_id long, unit int"), 700)
    score = np.round(x[of].astype(float) @ x[0].astype(float), 6)
    want = sorted(zip((-score).tolist(), range(len(of)), strict=True))[:700]
    assert [(r.chunk_id, r.score) for r in got.orderBy("rank").collect()] == [(k, -s) for s, k in want]
