"""Attempts per key in windows that start at a key's first attempt.

A window lasts a fixed time from the attempt that opened it; later attempts don't extend it, and refused ones count too.
Addresses are looked at first: an attempt that its address's limit refuses doesn't count for the user name.

Where a window starts hangs on the one before, but a key isn't read by one task for that. Attempts are sorted over all tasks by key
and time, and a task cuts them in pieces of bounded size. Whatever window is open when a piece begins, the first attempt after its
end opens the next one, and from there all follows: next-window pointers, walked from the piece's end, say for each attempt when
the last window of a chain that begins with it ends, and how many attempts that window has by then. Chains soon run together, so a
piece's answers are a few steps, and only these are folded along a key. Then each piece knows the window that it begins in."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import kept

#: Attempts of a piece.
PIECE = 4096
PIECES = "key string, ord long, ids array<long>, at array<long>, usernames array<string>"
NEVER = -(1 << 63)


def _mapped(df: DataFrame, f: Callable[[Iterator[tuple]], Iterator[dict]], schema: str) -> DataFrame:
    """f from the rows of a partition, in order, to rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in f(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            out.append(row)
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


def _pieces(rows: Iterator[tuple], most: int) -> Iterator[dict]:
    number, key, held = TaskContext.get().partitionId() << 32, None, []
    for k, i, at, name in rows:
        if held and (k != key or len(held) >= most):
            number += 1
            ids, times, names = zip(*held, strict=True)
            yield {"key": key, "ord": number, "ids": ids, "at": times, "usernames": names}
            held = []
        key = k
        held.append((i, at, name))
    if held:
        ids, times, names = zip(*held, strict=True)
        yield {"key": key, "ord": number + 1, "ids": ids, "at": times, "usernames": names}


def chains(at: list[int], seconds: int) -> list[tuple[int, int, int]]:
    """Steps (until, end, count): if the first attempt that opens a window comes at this time or before, but after the step before,
    the piece's last window ends then and has so many of its attempts."""
    n, last = len(at), [0] * len(at)
    for k in range(n - 1, -1, -1):
        after = bisect_left(at, at[k] + seconds)
        last[k] = last[after] if after < n else k
    steps: list[tuple[int, int, int]] = []
    for k in range(n):
        if k and at[k] == at[k - 1]:
            continue  # windows open at the first of equal times
        step = (at[k], at[last[k]] + seconds, n - last[k])
        if steps and steps[-1][1:] == step[1:]:
            steps.pop()
        steps.append(step)
    return steps


def _summaries(rows: Iterator[tuple], seconds: int) -> Iterator[dict]:
    for key, number, _, at, _ in rows:
        steps = chains(at, seconds)
        yield {"key": key, "ord": number, "n": len(at), "last": at[-1], "untils": [s for s, _, _ in steps], "ends": [e for _, e, _ in steps], "counts": [c for _, _, c in steps]}


def _entries(rows: Iterator[tuple]) -> Iterator[dict]:
    """Along each key: the end of the window that is open when a piece begins, and its attempts so far."""
    now, end, count = None, NEVER, 0
    for key, number, n, last, untils, ends, counts in rows:
        if key != now:
            now, end, count = key, NEVER, 0
        yield {"key": key, "ord": number, "end": end, "count": count}
        if end > last:
            count += n
        else:
            k = bisect_left(untils, end)
            end, count = ends[k], counts[k]


def _judged(rows: Iterator[tuple], limit: int, seconds: int) -> Iterator[dict]:
    for _, _, ids, at, usernames, end, count in rows:
        for i, time, name in zip(ids, at, usernames, strict=True):
            if time >= end:
                end, count = time + seconds, 0
            count += 1
            yield {"attempt_id": i, "at": time, "username": name, "retry_after": end - time if count > limit else None}


def limited(attempts: DataFrame, key: str, limit: int, seconds: int, piece: int = PIECE) -> DataFrame:
    """(attempt_id, at, username, retry_after): seconds to wait, or null for an attempt within the limit of its window."""
    rows = attempts.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "attempt_id", "at", "username")
    dealt = rows.repartitionByRange("key", "at", "attempt_id").sortWithinPartitions("key", "at", "attempt_id")
    pieces = kept(_mapped(dealt, lambda r: _pieces(r, piece), PIECES))
    steps = _mapped(pieces, lambda r: _summaries(r, seconds), "key string, ord long, n long, last long, untils array<long>, ends array<long>, counts array<long>")
    entries = _mapped(steps.repartition("key").sortWithinPartitions("key", "ord"), _entries, "key string, ord long, end long, count long")
    judged = pieces.join(entries, ["key", "ord"]).select("key", "ord", "ids", "at", "usernames", "end", "count")
    return _mapped(judged, lambda r: _judged(r, limit, seconds), "attempt_id long, at long, username string, retry_after long")


def rate_limit_windows(attempts: DataFrame, per_ip: int, per_username: int, seconds: int, piece: int = PIECE) -> DataFrame:
    """(attempt_id, blocked_by, retry_after) from (attempt_id, at in whole seconds, ip, username).

    blocked_by is ip, username or null. Attempts of one second go by attempt_id. A null ip or user name counts as an empty
    one; without rows there are none. seconds must be above zero."""
    if seconds <= 0:
        raise ValueError("a window must last")
    rows = attempts.select("attempt_id", "at", F.col("ip").cast("string").alias("ip"), F.col("username").cast("string").alias("username"))
    by_ip = kept(limited(rows, "ip", per_ip, seconds, piece))
    by_name = limited(by_ip.where("retry_after IS NULL"), "username", per_username, seconds, piece)
    name = F.when(F.col("retry_after").isNotNull(), F.lit("username")).alias("blocked_by")
    return by_ip.where("retry_after IS NOT NULL").select("attempt_id", F.lit("ip").alias("blocked_by"), "retry_after").unionByName(by_name.select("attempt_id", name, "retry_after"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")
    return rate_limit_windows(events.select(F.col("event_id").alias("attempt_id"), at, (F.col("user_id") % 31).alias("ip"), F.col("user_id").alias("username")), 20, 2, 86_400)


QUERIES = {"rate_limit_windows": _attempts}
