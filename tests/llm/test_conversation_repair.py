"""Repair of conversations in chunks against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridex.llm import conversation_repair as cr
from veridex.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The result for rows (turn, role, text) in order: all sequences of edits by recursion, at most two inserts in a row."""
    counts, seen, kinds = [0, 0, 0], set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        kinds.append(fault)

    @lru_cache(None)
    def best(i, made, inserts):
        """(cost, audit, lines) from row i on; made: initials so far as far as they matter."""
        found = []
        if i == len(rows) and made in ("", "a"):
            found.append((0, "", ()))
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[made]
        full = {"u": "user", "a": "assistant"}
        if inserts < 2:
            c, a, x = best(i, follow, inserts + 1)
            found.append((c + 2, "I" + a, (full[follow] + ":", *x)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, x = best(i + 1, made, 0)
            found.append((c + 3, "D" + a, x))
            if kinds[i] in (None, 2):
                more = kinds[i] == 2
                c, a, x = best(i + 1, follow, 0)
                found.append((c + 2 + more, "R" + a, (f"{full[follow]}:{text}", *x)))
                if role[:1] == follow or (role[:1] == "s" and made == ""):
                    c, a, x = best(i + 1, role[0], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *x)))
        return min(found, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # so that no call goes deep
        for made in ("", "s", "u", "a"):
            best(i, made, 0)
    cost, audit, lines = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def wanted(original, rows):
    return sorted((str(c), plain(in_order([r[1:] for r in rows if r[0] == c]))) for c in {r[0] for r in original})


def found(df):
    return sorted((str(r[0]), tuple(r)[1:]) for r in df.collect())


roles = st.sampled_from(["user", "assistant", "system", "tool", "user", "assistant"])
texts = st.sampled_from(["One.", "Two!", "cut", "", " \n", "Three?  ", "other"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), roles, texts), max_size=9))
def test_whole_conversations_equal_brute_force(rows):
    rows = in_order(rows)
    assert tuple(cr.solve(1, [(*r, 1) for r in rows]).values())[1:] == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.text("uasxUASXd", max_size=30), st.text("uasxUASXd", max_size=30))
def test_fix_up_passes_and_tables_give_the_true_vectors(left, right):
    whole = cr.run_back(left + right, cr.END)
    end = cr.run_back(right, cr.END)[0]
    assert whole[: len(left) + 1] == cr.run_back(left, end) == cr.run_back(left, end, cr.run_back(left, cr.END))
    table, costs = cr.table_back(left), cr.unpacked(end)
    assert cr.packed([min(table[4 * p + q] + costs[q] for q in range(4)) for p in range(4)]) == whole[0]


def many_rows():
    rng = random.Random(9)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.choice([1, 3, 8, 20])):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["A.", "B", "C!", "", " \t", None, f"{turn}?"])))
    hot = [(99, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(150)]
    hot += [(99, 200 + t, "tool", f"{t}.") for t in range(100)] + [(99, 400, "user", "same.")] * 70 + [(99, 500 + t, "user", "4.") for t in range(60)]
    return rows + hot


@pytest.mark.parametrize("passes", [0, 1, 50])
def test_pieces_equal_brute_force(spark, passes):
    rows = many_rows()
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(6), 7, passes)
    assert found(got) == wanted(rows, filled)


def test_query_equals_brute_force(spark):
    from veridex.llm import common

    rows = [tuple(r) for r in common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_conversation_repair"](spark, SF)) == wanted(rows, damage(rows))


def test_awkward_rows(spark):
    rows = [(*r, "x") for r in many_rows()] + [(7, -(1 << 63), "user", "long " * 100_000, "x"), (7, (1 << 63) - 1, "admin", "Z.", "x"), (8, 1, "", "Z.", "x")]
    rows += [(conv, 1, "user", "x", "y") for conv in range(1000, 1040)]  # some lose all rows
    want = wanted(rows, damage([r[:4] for r in rows]))
    want = [(c, (min(r[0], (1 << 63) - 1), *r[1:])) for c, r in want]
    df = spark.createDataFrame(rows, SCHEMA + ", cost string")
    assert found(cr.repair_conversations(cr.damaged(df))) == want
    assert ("1010", (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) in want or any(r[1][6] == "" for r in want)
    assert cr.repair_conversations(cr.damaged(df.limit(0))).count() == 0
