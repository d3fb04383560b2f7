"""Cover density against all stretches of each chunk."""

import random

from veridex import registry
from veridex.operators.covers import cover_density_rank


def plain(words, terms):
    at = range(len(words))
    full = [(a, b) for a in at for b in at if a <= b and set(terms) <= set(words[a : b + 1])]
    covers = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return len(covers), sum(1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in covers)


def test_covers(spark):
    rng = random.Random(3)
    chunks = {i: rng.choices("abcdxyz", k=rng.randrange(1, 25)) for i in range(60)}
    terms = {0: ["a"], 1: ["a", "b"], 2: ["a", "b", "c"]}
    rows = [(q, c, i, w, len(t)) for q, t in terms.items() for c, words in chunks.items() for i, w in enumerate(words) if w in t]
    frame = spark.createDataFrame(rows + rows[:5], "request_id long, chunk_id long, place int, term string, n_terms int")
    got = {(r.request_id, r.chunk_id): (r.covers, round(r.score, 9)) for r in cover_density_rank(frame).collect()}
    want = {(q, c): plain(words, t) for q, t in terms.items() for c, words in chunks.items() if set(words) & set(t)}
    assert got == {k: (n, round(s, 9)) for k, (n, s) in want.items()}


def test_query(spark):
    rows = registry.QUERIES["cover_density_rank"](spark, "/root/testdata/sf0.001").collect()
    match = registry.QUERIES["keyword_and_match"](spark, "/root/testdata/sf0.001").count()
    assert len(rows) == match > 0
    assert all(r.covers > 0 and 0 < r.score <= r.covers for r in rows)
