"""Cheapest repair of conversations' structure by a Viterbi search that runs in chunks.

A repaired conversation is empty, or a system row or none and then user and assistant rows in turns. What the rows so far allow
is one of four states, so the costs of repairing the rest of a conversation are a vector of four numbers at each row, worked out
from the last row backwards. Vectors that differ by a constant choose the same edits; only their differences are kept.

Conversations that lie in one partition are solved there. The others, and those too long for one piece, are cut in pieces that
many tasks hold. Each piece starts from a speculative vector (as if the conversation ended after it). In fix-up passes a piece
whose successor's first vector isn't the one it started from runs again, until its vector differs only by a constant from the one
it had at that row; from there on all it had stands. Pieces through which differences persist (rows that must go, say) would make
passes many; after a few of them, what is left gets tables of four by four costs, which are folded piece by piece. With all
vectors true, the least audit is traced forwards: of the edits that lead to the least cost, the one whose initial comes first.
A piece says to which state it leads from each state; folding that gives the state in which each piece begins."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: nothing yet, after a system row, after a user row, after an assistant row; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or re-roled row leads to, and its role.
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: The state that a kept row of this initial leads to.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "x": (None,) * 4}
#: Inserts that end a conversation in each state.
CLOSING = (0, 2, 1, 0)
NO_WORD = " \t\n\r\x0b\x0c"
#: A piece has at most so many rows and about so many characters.
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 20
#: Fix-up passes before tables are made.
PASSES = 3
FAR = 1 << 30


def packed(costs: list[int]) -> int:
    low = min(costs)
    return sum(x - low << 4 * k for k, x in enumerate(costs))


def unpacked(vector: int) -> list[int]:
    return [vector >> 4 * k & 15 for k in range(4)]


END = packed([INSERT * n for n in CLOSING])


def costs_before(after: list[int], code: str) -> list[int]:
    """The costs before a row from those after it. code: d for a row that must go, else the initial of the role (x for any that
    no state takes), as a capital if the row is truncated."""
    if code == "d":
        out = [DELETE + x for x in after]
    else:
        more, kept = code.isupper(), KEPT[code.lower()]
        out = [min(DELETE + after[q], REROLE + more + after[FORCED[q]], FAR if kept[q] is None else KEEP + more + after[kept[q]]) for q in range(4)]
    user, assistant = out[USER], out[ASSISTANT]
    out[USER], out[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(out[q], INSERT + out[USER]) if q in (START, SYSTEM) else out[q] for q in range(4)]


@lru_cache(None)
def before(after: int, code: str) -> int:
    return packed(costs_before(unpacked(after), code))


@lru_cache(None)
def edits(after: int, code: str, state: int) -> tuple[str, int]:
    """The initials of the edits up to and with this row, and the state after it."""
    rest = unpacked(after)
    costs = costs_before(rest, code)
    done = ""
    while True:
        if costs[state] == DELETE + rest[state]:
            return done + "D", state
        if costs[state] == INSERT + costs[FORCED[state]]:
            done, state = done + "I", FORCED[state]
            continue
        kept = KEPT[code.lower()][state]
        if kept is not None and costs[state] == KEEP + code.isupper() + rest[kept]:
            return done + "K", kept
        return done + "R", FORCED[state]


def run_back(codes: str, end: int, known: array | None = None) -> array:
    """The vectors before each row and, last, the one after all; from the row on where a known run has the same, that one's."""
    vectors = known[:] if known else array("H", bytes(2 * len(codes) + 2))
    vectors[-1] = end
    for k in range(len(codes) - 1, -1, -1):
        now = before(vectors[k + 1], codes[k])
        if known and now == known[k]:
            break
        vectors[k] = now
    return vectors


def table_back(codes: str) -> list[int]:
    """Costs from each state before the rows to each state after them, row by row. Rows that must go only add a constant."""
    columns = [[0 if p == q else FAR for p in range(4)] for q in range(4)]
    for code in reversed(codes):
        columns = [[min(x, FAR) for x in costs_before(c, code)] for c in columns]
        low = min(map(min, columns))
        columns = [[x if x >= FAR else x - low for x in c] for c in columns]
    return [columns[q][p] for p in range(4) for q in range(4)]


def trace(codes: str, vectors: array, state: int) -> tuple[list[str], int]:
    out = []
    for k, code in enumerate(codes):
        letters, state = edits(vectors[k + 1], code, state)
        out.append(letters)
    return out, state


class Piece:
    """Consecutive rows (turn, role, text, copies) of a conversation; seen: keys of role and text that earlier pieces have."""

    def __init__(self, rows: list[tuple], seen: frozenset = frozenset()):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.rows, codes, own = [], [], set()
        turns = [r[0] for r in rows if r[0] is not None and r[3]]
        self.first_turn, self.last_turn, self.turns = min(turns, default=None), max(turns, default=None), len(set(turns))
        self.first, self.last = None, None
        for _, role, text, copies in rows:
            if not copies:
                continue
            initial, words = role[:1], text.rstrip(NO_WORD)
            code = initial if initial in ("s", "u", "a") else "x"
            key = (role, text)
            if not words:
                self.counts["blank"] += copies
                code, extra = "d", "d" * (copies - 1)
            else:
                again = key in own or bool(seen) and row_key(role, text) in seen
                own.add(key)
                extra = "d" * (copies - 1)
                self.counts["duplicate"] += copies - 1 + again
                if again:
                    code = "d"
                elif words[-1] not in ".!?":
                    self.counts["truncated"] += 1
                    code = code.upper()
            if self.last is not None:
                self.counts["illegal"] += illegal(self.last, initial)
            self.first = initial if self.first is None else self.first
            self.last = initial
            self.counts["illegal"] += copies - 1  # no role may follow itself
            codes.append(code + extra)
            self.rows += [(role, text)] * copies
        self.codes = "".join(codes)

    def repaired(self, vectors: array, state: int) -> tuple[str, list[str], int, int]:
        """The audit, the lines of the repaired rows, their cost and the state after them."""
        steps, _ = trace(self.codes, vectors, state)
        lines, cost = [], 0
        for (role, text), code, letters in zip(self.rows, self.codes, steps, strict=True):
            for letter in letters:
                cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter] + (letter in "KR" and code.isupper())
                if letter == "K":
                    lines.append(f"{role}:{text}")
                    state = KEPT[code.lower()][state]
                elif letter != "D":
                    lines.append(f"{ROLE[state]}:{text if letter == 'R' else ''}")
                    state = FORCED[state]
        return "".join(steps), lines, cost, state


def illegal(one: str, next_one: str) -> bool:
    return one + next_one not in ("su", "ua", "au")


def row_key(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Whole:
    """A conversation's result, put together from its pieces in order; lines of text only pass through the hash."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.cost = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), 0
        self.audit, self.hash, self.state, self.any_line = [], hashlib.sha256(), START, False
        self.low = self.high = self.last = None
        self.turns = 0

    def add(self, counts: dict, first: str | None, last: str | None, low: int | None, high: int | None, turns: int, audit: str, lines: list[str], cost: int, state: int) -> None:
        for name in self.counts:
            self.counts[name] += counts[name]
        if self.last is not None and first is not None:
            self.counts["illegal"] += illegal(self.last, first)
        self.last = self.last if last is None else last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        self.audit.append(audit)
        self.cost += cost
        self._lines(lines)
        self.state = state

    def _lines(self, lines: list[str]) -> None:
        if lines:
            self.hash.update((("\n" if self.any_line else "") + "\n".join(lines)).encode())
            self.any_line = True

    def row(self) -> dict:
        for _ in range(CLOSING[self.state]):
            self.audit.append("I")
            self.cost += INSERT
            self._lines([f"{ROLE[self.state]}:"])
            self.state = FORCED[self.state]
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def solve(conv_id: int | None, rows: list[tuple]) -> dict:
    """The result of a conversation whose rows are at hand."""
    piece, whole = Piece(rows), Whole(conv_id)
    audit, lines, cost, state = piece.repaired(run_back(piece.codes, END), START)
    whole.add(piece.counts, piece.first, piece.last, piece.first_turn, piece.last_turn, piece.turns, audit, lines, cost, state)
    return whole.row()


def _weight(value: object) -> int:
    return len(value) if isinstance(value, (str, bytes)) else sum(map(_weight, value)) if isinstance(value, list) else 8


def _mapped(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """f from the rows of a partition, in order, to rows; it sees one after another."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, names = to_arrow_schema(StructType.fromDDL(schema)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in (part for whole in batches for part in common.slices(whole)):
                for values in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
                    yield dict(zip(names, values, strict=True))

        out, held = [], 0
        for row in f(rows()):
            out.append(row)
            held += 100 + sum(map(_weight, row.values()))
            if held > 4 << 20 or len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with the damage of op13's contract; dropped rows have 0 copies and nothing else."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    there = F.col("code") != 0
    return rows.select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"), copies.cast("long").alias("copies"))


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one row with the sum of their copies."""
    names = ["conv_id", "turn", "role", "text"]
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(names).aggregate([("copies", "sum")])
        yield from found.select([*names, "copies_sum"]).rename_columns([*names, "copies"]).to_batches()


PIECES = "ord long, turns array<long>, roles array<string>, texts array<string>, copies array<long>"


def _pieces(rows: Iterator[dict], most: int = PIECE_ROWS) -> Iterator[dict]:
    """Results of conversations that surely lie in this partition as a whole, and pieces of the others."""
    number = TaskContext.get().partitionId() << 32
    now, held, chars, edge, began = None, [], 0, True, False

    def piece() -> dict:
        nonlocal number
        number += 1
        turns, roles, texts, copies = map(list, zip(*held, strict=True)) if held else ([], [], [], [])
        return {"conv_id": now, "ord": number, "turns": turns, "roles": roles, "texts": texts, "copies": copies}

    for row in rows:
        if began and row["conv_id"] != now:
            yield piece() if edge else solve(now, held)
            held, chars, edge = [], 0, False
        now, began = row["conv_id"], True
        left = row["copies"]
        while left:
            if len(held) >= most or (held and chars + len(row["text"]) > PIECE_CHARS):
                yield piece()
                held, chars, edge = [], 0, True
            held.append((row["turn"], row["role"], row["text"], min(left, most)))
            chars += len(row["text"])
            left -= held[-1][3]
    if began:
        yield piece()


CODED = "id string, ord long, codes string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, vectors binary, used int, start int"


def _rows_of(row: dict) -> list[tuple]:
    return list(zip(row["turns"], row["roles"], row["texts"], row["copies"], strict=True))


def _coded(rows: Iterator[dict]) -> Iterator[dict]:
    """The codes of each piece and its run from a speculative vector."""
    for row in rows:
        piece = Piece(_rows_of(row), frozenset(row["seen"] or ()))
        vectors = run_back(piece.codes, END)
        turns = {"low": piece.first_turn, "high": piece.last_turn, "turns": piece.turns}
        yield {"id": row["id"], "ord": row["ord"], "codes": piece.codes, **piece.counts, "first": piece.first, "last": piece.last, **turns, "vectors": vectors.tobytes(), "used": END, "start": vectors[0]}


def _again(rows: Iterator[dict]) -> Iterator[dict]:
    """A fix-up pass: pieces whose end isn't what they started from run again, as far as that changes anything."""
    for row in rows:
        end = row.pop("end")
        if end != row["used"]:
            vectors = run_back(row["codes"], end, array("H", row["vectors"]))
            row |= {"vectors": vectors.tobytes(), "used": end, "start": vectors[0]}
        yield row


def _tables(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        yield {"id": row["id"], "ord": row["ord"], "table": table_back(row["codes"])}


def _fold_ends(rows: Iterator[dict]) -> Iterator[dict]:
    """From the last piece of each conversation to the first: the vector after each piece."""
    now, costs = None, []
    for row in rows:
        if row["id"] != now:
            now, costs = row["id"], unpacked(END)
        yield {"id": now, "ord": row["ord"], "end": packed(costs)}
        table = row["table"]
        costs = unpacked(packed([min(table[4 * p + q] + costs[q] for q in range(4)) for p in range(4)]))


def _exits(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        vectors = array("H", row["vectors"])
        yield {"id": row["id"], "ord": row["ord"], "exits": [trace(row["codes"], vectors, q)[1] for q in range(4)]}


def _fold_entries(rows: Iterator[dict]) -> Iterator[dict]:
    now, state = None, START
    for row in rows:
        if row["id"] != now:
            now, state = row["id"], START
        yield {"id": now, "ord": row["ord"], "entry": state}
        state = row["exits"][state]


REPAIRED = "id string, conv_id long, ord long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, audit string, lines array<string>, cost long, state int"


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        piece = Piece(_rows_of(row), frozenset(row["seen"] or ()))
        audit, lines, cost, state = piece.repaired(array("H", row["vectors"]), row["entry"])
        turns = {"low": piece.first_turn, "high": piece.last_turn, "turns": piece.turns}
        yield {"id": row["id"], "conv_id": row["conv_id"], "ord": row["ord"], **piece.counts, "first": piece.first, "last": piece.last, **turns, "audit": audit, "lines": ["\n".join(lines)] if lines else [], "cost": cost, "state": state}


def _assembled(rows: Iterator[dict]) -> Iterator[dict]:
    now, whole = None, None
    for row in rows:
        if row["id"] != now:
            if whole:
                yield whole.row()
            now, whole = row["id"], Whole(row["conv_id"])
        whole.add(row, *(row[c] for c in ("first", "last", "low", "high", "turns", "audit", "lines", "cost", "state")))
    if whole:
        yield whole.row()


def _in_order(df: DataFrame, back: bool = False) -> DataFrame:
    """The pieces of a conversation one after another in a partition; they are small rows, thousands of rows of text each."""
    return df.repartition("id").sortWithinPartitions("id", F.desc("ord") if back else F.asc("ord"))


def _stitched(pieces: DataFrame, passes: int) -> DataFrame:
    """Results of conversations from their pieces."""
    pair = ["id", "ord"]
    named = pieces.withColumn("id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    rows = F.arrays_zip("roles", "texts")
    keys = named.select("id", "ord", F.explode(F.array_distinct(F.transform(rows, lambda r: F.md5(F.concat(F.length(r["roles"]).cast("string"), F.lit(":"), r["roles"], r["texts"]))))).alias("key"))
    first = keys.groupBy("id", "key").agg(F.min("ord").alias("ord_first"), F.max("ord").alias("ord_last")).where("ord_first < ord_last")
    later = keys.join(first, ["id", "key"]).where("ord > ord_first").groupBy(*pair).agg(F.collect_list("key").alias("seen"))
    known = common.cut(named.join(later, pair, "left"))
    state = common.cut(_mapped(known.select(*pair, "turns", "roles", "texts", "copies", "seen"), _coded, CODED))
    order = Window.partitionBy("id").orderBy("ord")

    def rerun(ends: DataFrame) -> None:
        nonlocal state
        columns = state.columns
        old, state = state, common.cut(_mapped(state.join(ends, pair).select(*columns, "end"), _again, CODED))
        common.forget(old)

    for _ in range(passes):
        ends = state.select(*pair, "used", F.lead("start", 1, END).over(order).alias("end"))
        if ends.where("end <> used").isEmpty():
            break
        rerun(ends.select(*pair, "end"))
    else:
        tables = _mapped(state.select(*pair, "codes"), _tables, "id string, ord long, table array<long>")
        rerun(_mapped(_in_order(tables, True), _fold_ends, "id string, ord long, end int"))
    exits = _mapped(state.select(*pair, "codes", "vectors"), _exits, "id string, ord long, exits array<int>")
    entries = _mapped(_in_order(exits), _fold_entries, "id string, ord long, entry int")
    solved = known.join(state.select(*pair, "vectors"), pair).join(entries, pair)
    out = _mapped(_in_order(_mapped(solved.select(*pair, "conv_id", "turns", "roles", "texts", "copies", "seen", "vectors", "entry"), _repaired, REPAIRED)), _assembled, RESULT)
    done = common.cut(out)
    common.forget(known, state)
    return done


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS, passes: int = PASSES) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, copies): gaps in turns, faults, and the cheapest repair.

    Rows go by turn, nulls first, then by role and text; copies says how often a row stands there, 0 only makes the conversation
    known (without this column each row stands once). Null conv_ids are one conversation; null roles and texts count as one
    space; repeated rows are duplicates; extra columns are ignored. Without rows there are no conversations. Rows are sorted over all tasks by ranges, so that a conversation of any length is spread
    over many; equal rows are joined before they move. Only the hash of a repaired text, which can't be split, is worked out by
    one task for a conversation, from joined lines of thousands of rows at a time. Gaps stop at the greatest long."""
    copies = F.coalesce("copies", F.lit(1)).cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    few = rows.select("conv_id", "turn", *filled, copies.alias("copies")).mapInArrow(_fewer, "conv_id long, turn long, role string, text string, copies long")
    dealt = few.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 128)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"{RESULT}, {PIECES}"
    found = common.cut(_mapped(dealt, lambda rows: _pieces(rows, piece_rows), schema))
    whole = found.where("ord IS NULL").select(*[c.split()[0] for c in RESULT.split(", ")])
    pieces = found.where("ord IS NOT NULL").select("conv_id", "ord", "turns", "roles", "texts", "copies")
    return whole.unionByName(_stitched(pieces, passes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(common.table(spark, sf_dir, "conversations")))
