"""Runs of words by block convolution against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veridex.llm import periodic_runs
from veridex.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period from the smallest, every stretch of words that equal the one a period further on."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, k, q) for (s, k), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(keep)))


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        blocks = rng.integers(1, 3, (20, size))
        windows = rng.integers(0, 3, (20, 2 * size - 1))
        windows[::3, size // 2 : size // 2 + size] = blocks[::3]
        want = np.array([[((b - w[s : s + size]) ** 2).sum() == 0 for s in range(size)] for b, w in zip(blocks, windows, strict=True)])
        assert (periodic_runs.occurrences(blocks, windows) == want).all()
        assert want.any()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=9))
def test_runs_equal_brute_force(parts):
    words = [w for part, times in parts for w in part * times]
    assert periodic_runs.runs_of([words, [], words[1:]]) == [plain_runs(words), [], plain_runs(words[1:])]


def test_long_runs_and_nested_runs():
    rng = random.Random(3)
    inner = ["x"] * 40 + [str(rng.random()) for _ in range(50)]
    for words in (["a"] * 5000, inner * 7 + ["end"], ["s"] + inner * 4 + inner[:30], (["p", "q"] * 8 + ["r"]) * 5, [str(i) for i in range(3000)]):
        assert periodic_runs.runs_of([words]) == [plain_runs(words)]


def test_query_equals_brute_force(spark):
    from veridex.llm import common

    got = QUERIES["op11_periodic_runs"](spark, SF)
    want = [plain_row(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[1] for w in want) > 5


def test_awkward_rows(spark):
    rows = [(None, "a " * 8, 1), (1, None, 2), (1, "", 3), (1, "\t\n ", 4), (2, "b c " * 4, 5), (2, "b c " * 4, 5), (3, "d\x0be e d\x0ce e " * 4, 6), (4, "w" * 300_000 + " z" * 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs long")
    want = [plain_row(i, t)[1:] for i, t, _ in rows if i != None or t]  # noqa: E711
    got = periodic_runs.periodic_runs(docs, periodic_runs.damage)
    assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, want))
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    kept = [tuple(r) for r in periodic_runs.collapse_runs(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, "a", 1), (1, None, 2), (1, "", 3), (1, "\t\n ", 4), (2, "b c", 5), (2, "b c", 5), (3, "d e e", 6), (4, "w" * 300_000 + " z", 7)]))
