"""Ingestion, snapshots and limits of attempts against plain loops."""

import random

import pytest

from veridex import registry
from veridex.streaming import ingest, limits

SF = "/root/testdata/sf0.001"


def test_a_replay_adds_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "chunks")
    rows = [(1, "a\n\n b\nc"), (1, "a\n\n b\nc"), (2, None), (3, ""), (4, "a")]
    spark.createDataFrame(rows, ingest.DOCUMENTS).write.parquet(source)
    first = sorted((r.doc_id, r.chunk_index, r.line) for r in ingest.stream_ingest(spark, source, target, str(tmp_path / "one")).collect())
    assert first == [(1, 0, "a"), (1, 1, " b"), (1, 2, "c"), (4, 0, "a")]
    again = ingest.stream_ingest(spark, source, target, str(tmp_path / "two"))  # a new checkpoint reads all once more
    assert again.count() == len(first)
    spark.createDataFrame([(1, "a\n\n b\nc"), (5, "new")], ingest.DOCUMENTS).write.mode("append").parquet(source)
    more = ingest.stream_ingest(spark, source, target, str(tmp_path / "one"))
    assert sorted((r.doc_id, r.line) for r in more.collect()) == sorted([(d, t) for d, _, t in first] + [(5, "new")])


def test_a_snapshot_is_whole_and_never_changes(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 20, "c")], "generation_id long, chunk_id long, line string")
    vectors = spark.createDataFrame([(10, [1.0]), (11, [0.5])], "chunk_id long, embedding array<double>")
    generations = spark.createDataFrame([(1,), (2,), (3,)], "generation_id long")
    path = str(tmp_path / "s")
    got = sorted(tuple(r) for r in ingest.snapshot_write(chunks, vectors, generations, path).collect())
    assert got == [(1, 2, 2, 2, True), (2, 1, 1, 0, False), (3, 0, 0, 0, True)]
    with pytest.raises(Exception, match="already exists"):
        ingest.snapshot_write(chunks, vectors, generations, path)


def plain_limits(rows, per_ip, per_username, seconds):
    """One pass in order of time over counters that expire."""
    counters, out = {}, {}
    for n, at, ip, name in sorted(rows, key=lambda r: (r[1], r[0])):
        out[n] = (None, None)
        for kind, key, limit in (("ip", ip or "", per_ip), ("username", name or "", per_username)):
            start, count = counters.get((kind, key), (at, 0))
            if at >= start + seconds:
                start, count = at, 0
            counters[kind, key] = start, count + 1
            if count + 1 > limit:
                out[n] = kind, start + seconds - at
                break
    return out


@pytest.mark.parametrize("piece", [1, 7, 40])
def test_windows_across_pieces(spark, piece):
    rng = random.Random(piece)
    rows = [(i, rng.randrange(3000) // rng.choice([1, 1, 50]), "hot" if i % 3 else "rare", "n") for i in range(600)]
    frame = spark.createDataFrame(rows, "attempt_id long, at long, ip string, username string").repartition(5)
    for per_ip, per_name, seconds in ((3, 2, 40), (1, 5, 1), (10, 10, 5000)):
        got = {r.attempt_id: (r.blocked_by, r.retry_after) for r in limits.rate_limit_windows(frame, per_ip, per_name, seconds, piece).collect()}
        assert got == plain_limits(rows, per_ip, per_name, seconds)


def test_steps_are_few(spark):
    steps = limits.chains(sorted(random.Random(1).randrange(100_000) for _ in range(4000)), 700)
    assert len(steps) < 200


def test_a_batch_reads_its_own_part(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "chunks")
    spark.createDataFrame([(i, f"text {i}") for i in range(300)], ingest.DOCUMENTS).write.parquet(source)
    ingest.stream_ingest(spark, source, target, str(tmp_path / "one"))
    parts = {p.name for p in (tmp_path / "chunks").glob("batch=*/prefix=*")}
    assert len(parts) > 100 and all(len(p) == len("prefix=") + ingest.PREFIX for p in parts)
    plan = ingest.stored_chunks(spark, target).where("prefix IN ('00', '0a')").select("ingest_key")._jdf.queryExecution().toString()
    assert "PartitionFilters: [prefix" in plan


def test_rate_limit_windows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(2000), rng.choice(["x", "y", None]), rng.choice("abcdef")) for i in range(900)]
    frame = spark.createDataFrame(rows, "attempt_id long, at long, ip string, username string")
    got = {r.attempt_id: (r.blocked_by, r.retry_after) for r in limits.rate_limit_windows(frame, 20, 8, 150).collect()}
    assert got == plain_limits(rows, 20, 8, 150)
    assert {k for k, _ in got.values()} == {None, "ip", "username"}
    assert limits.rate_limit_windows(frame.limit(0), 20, 8, 150).count() == 0


def test_queries(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = [(r.event_id, r.at, str(r.user_id % 31), str(r.user_id)) for r in events.selectExpr("event_id", "unix_timestamp(cast(ts as timestamp)) AS at", "user_id").collect()]
    got = {r.attempt_id: (r.blocked_by, r.retry_after) for r in registry.QUERIES["rate_limit_windows"](spark, SF).collect()}
    assert got == plain_limits(rows, 20, 2, 86_400)
    snapshot = registry.QUERIES["snapshot_write"](spark, SF)
    assert snapshot.where("chunks > 0 and not complete").count() == 0
    assert snapshot.where("complete and chunks > 0").count() > 0
