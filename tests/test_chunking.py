"""Splitting and packing by a plain reading, and on awkward rows."""

import random

from veridex.operators import chunking

SCHEMA = "doc_id long, ordinal long, heading string, page long, text string, extra string"


def count(text):
    return len(chunking.word_spans(text))


def test_short_blocks_stay_whole_and_long_ones_are_cut():
    text = " ".join(f"w{i}" for i in range(100))
    assert [p.text for p in chunking.split_block(0, text, 100, 10)] == [text]
    pieces = chunking.split_block(0, text, 30, 10)
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    assert all(count(p.text) == p.tokens <= 30 and text[p.start : p.end] == p.text for p in pieces)
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a.start < b.start <= a.end and count(text[b.start : a.end]) == 10
    assert chunking.split_block(0, text, 0, 10) == []
    assert [p.tokens for p in chunking.split_block(0, text, 1, 60)] == [1] * 100


def test_packing_keeps_its_rules():
    rng = random.Random(1)
    for _ in range(200):
        blocks, heading, page = [], "", 1
        for k in range(rng.randint(1, 25)):
            heading = rng.choice([heading, heading, heading, f"H{k} a b"])
            page += rng.random() < 0.1
            blocks.append((k, heading, page, rng.choice(["", "  "]) if rng.random() < 0.05 else " ".join("x" * rng.randint(1, 5) for _ in range(rng.choice([3, 20, 60, 150])))))
        chunks, failed = chunking.pack(blocks, 60, 10, 80)
        of = {o: (h, p, t) for o, h, p, t in blocks}
        assert not failed
        covered = {}
        for n, chunk in enumerate(chunks):
            heading, page, _ = of[chunk[0].ordinal]
            assert all(of[p.ordinal][:2] == (heading, page) for p in chunk)
            assert len({p.ordinal for p in chunk}) == len(chunk)
            assert all(of[p.ordinal][2][p.start : p.end] == p.text for p in chunk)
            assert count(heading) + count("\n\n".join(p.text for p in chunk)) <= 80
            for p in chunk:
                covered.setdefault(p.ordinal, []).append((p.start, p.end))
            # a chunk is full: what comes next has another place, is of the same block, or would lead over the target
            if n + 1 < len(chunks):
                after = chunks[n + 1]
                carried = after[0].ordinal == chunk[-1].ordinal and after[0].end == chunk[-1].end and len(after) > 1
                first = after[1] if carried else after[0]
                same_place = of[first.ordinal][:2] == (heading, page)
                over = count(heading) + count(" ".join(p.text for p in chunk)) + first.tokens > 60
                assert not same_place or first.ordinal == chunk[-1].ordinal or over
        for o, (_, _, t) in of.items():
            if t.strip():  # nothing is lost
                end = 0
                for s, e in sorted(covered[o]):
                    assert not t[end:s].strip()
                    end = max(end, e)
                assert not t[end:].strip()
            else:
                assert o not in covered


def test_as_queries_on_awkward_rows(spark):
    rows = [(1, 0, "H", 1, "a b c", "z"), (1, 1, "H", 1, None, "z"), (1, 2, None, 1, " ".join(["w"] * 1000), "z"), (2, 0, "x " * 600, 1, "too much heading", "z"), (3, 0, "", None, "  ", "z"), (None, 0, "", 1, "no id", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = {(r["doc_id"], r["ordinal"], r["piece"]): r["tokens"] for r in chunking.split_oversized_blocks(df).collect()}
    assert pieces == {(1, 0, 0): 3, (1, 2, 0): 512, (1, 2, 1): 512, (1, 2, 2): 96, (2, 0, None): None, (None, 0, 0): 2}
    chunks = {(r["doc_id"], r["chunk_index"]): r["segments"] for r in chunking.heading_pack_chunks(df).collect()}
    assert chunks[1, 0] == "0:0-5" and len([k for k in chunks if k[0] == 1]) == 4 and (2, 0) not in chunks and (3, 0) not in chunks
    assert chunking.heading_pack_chunks(df.limit(0)).count() == chunking.split_oversized_blocks(df.limit(0)).count() == 0
