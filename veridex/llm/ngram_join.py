"""Near duplicates by word shingles: an exact Jaccard join whose candidates pass filters under several global token orders.

A document is the set of its distinct five-word shingles (64-bit hashes). Equal sets form one class, and only one document of
each class goes on. If two sets reach the threshold, their prefixes (first tokens under any fixed order) share a token. Under
the first order frequent tokens come last, by counts over all documents and, for rarer ones, over a part of the sets; documents that share a prefix token under it, within
the bounds that size and position set, meet. Two that meet are candidates only if their prefixes also share a token under the
second order (the same levels of frequency, other ties) and under the third (plain hashes). What passes all orders is verified: by
a few bits for each member first, which show exactly how much two sets surely differ, then by the members, which only then move.

Only connected components are asked for, so pairs inside a component that is known already need no test. A token's sharers
are tested against members of the token's largest component, first one, then more and more of them, the most shared document
first; a large group of copies so costs a few tests a document. Tokens whose sharers lie in one component are done with. What is
still apart after these rounds is tested pair by pair, over all pairs of different components that share a token in place.

Null and empty texts have no shingles and are linked with nothing; up to four words are one shingle. Repeated rows fall in
one class. A row without doc_id takes part only through rows of its class that have one; without any, its component is
null. Rows of one doc_id with different texts count as one document with several texts. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import components, forget, map_arrow, slices, strings, table, text_groups

WORDS = 5
#: Odd constants for hashing.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Ties under the second order, and the whole third order, come from hashes by these constants.
SECOND, THIRD = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Each round tests against so many members of a large component; what is still apart then is tested pair by pair.
PIVOTS = (1, 8, 32)
#: So many of the most frequent shingles get levels of frequency at most, whole levels from the top; others are ordered by hash.
#: Any order gives the same result.
FREQUENT = 500_000
#: Shingles too rare for a summary are counted in one of so many distinct sets, and only if their hash is low enough for a prefix.
COUNTED, LOW = 4, np.uint64(3 << 61)
#: A task's summary of frequent shingles: one that it holds more often than its tokens / SUMMARY times is surely in it.
SUMMARY = 100_000
BROADCAST_ROWS = 500_000
#: What goes to a Python worker at once: both of an executor's heap and its workers must fit, and numpy's tables follow this.
BATCH = "2m"
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def cut(df: DataFrame) -> DataFrame:
    """A table as common.cut() writes it, worked out in small batches."""
    return common.cut(df, BATCH)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each of 256 places of a word; a word's hash adds up those of its bytes. Unlike a polynomial
#: modulo a power of two this tells words of the Thue-Morse kind apart.
PLACES = 256
BYTE_AT_PLACE = mix(mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(STEP)))


def _byte_values(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    value = BYTE_AT_PLACE[(place & (PLACES - 1)) << 8 | data]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(MIX_A))
    return value


def word_hashes(texts: list[bytes], stretch: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of the text of each. Bytes are read stretch by stretch, also within a word."""
    joined = b" ".join(texts) + b" "
    out, begun = [], []
    open_at, open_sum = None, np.zeros(1, np.uint64)  # of a word that goes on into the next stretch
    for at in range(0, len(joined), stretch):
        data = np.frombuffer(joined, np.uint8, min(stretch, len(joined) - at), at)
        blank = BLANK[data]
        before = np.concatenate([[open_at is None], blank[:-1]])
        starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        first = np.full(len(data), 0 if open_at is None else open_at - at)
        first[starts] = starts
        place = np.where(blank, 0, np.arange(len(data)) - np.maximum.accumulate(first))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.where(blank, np.uint64(0), _byte_values(data, place)), out=sums[1:])
        begin, less = starts + at, sums[starts]
        if open_at is not None:
            begin, less = np.append(open_at, begin), np.append(np.zeros(1, np.uint64) - open_sum, less)
        n = len(ends)
        out.append(mix(sums[ends] - less[:n] + (ends + at - begin[:n]).astype(np.uint64)))
        begun.append(begin[:n])
        open_at, open_sum = (int(begin[n]), sums[-1:] - less[n:]) if len(begin) > n else (None, open_sum)
    hashes, starts = np.concatenate(out), np.concatenate(begun)
    bounds = np.fromiter(map(len, texts), np.int64, len(texts)).cumsum() + np.arange(1, len(texts) + 1)
    return hashes, np.searchsorted(bounds, starts, side="right")


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    none = np.empty(0, np.uint64)
    for a, b in text_groups(texts, 1 << 19):
        raw = [t.encode("utf-8", "replace").lower() for t in texts[a:b]]
        hashes, owner = word_hashes(raw)
        n = np.bincount(owner, minlength=b - a)
        salt = [np.uint64(pow(STEP, k + 1, 1 << 64)) for k in range(words)]
        if len(hashes) >= words:
            m = len(hashes) - words + 1
            shingle = np.zeros(m, np.uint64)
            for k in range(words):
                shingle += hashes[k : k + m] * salt[k]
            shingle = mix(shingle)
            ok = owner[:m] == owner[words - 1 :]
            shingle, of = shingle[ok], owner[:m][ok]
        else:
            shingle, of = none, np.empty(0, np.int64)
        cuts = np.searchsorted(of, np.arange(b - a + 1))
        first = np.concatenate([[0], n.cumsum()])
        for i in range(b - a):
            if n[i] >= words:
                out.append(np.unique(shingle[cuts[i] : cuts[i + 1]]))
            elif n[i]:
                own = hashes[first[i] : first[i + 1]]
                out.append(mix(np.array([sum(int(h) * int(s) for h, s in zip(own, salt, strict=False)) + int(n[i]) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(none)
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _kept_counts(token: np.ndarray, count: np.ndarray, more: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A summary of frequent items (Misra and Gries) with further counts: size of them at most, each too low by what all lose."""
    both, at = np.unique(np.concatenate([token, more]), return_inverse=True)
    total = np.bincount(at, np.concatenate([count, n]), minlength=len(both)).astype(np.int64)
    if len(both) > size:
        total -= np.partition(total, len(total) - size - 1)[len(total) - size - 1]
        both, total = both[total > 0], total[total > 0]
    return both, total


SURVEY = "kind int, doc_id long, row_key long, n long, d1 long, d2 long"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at a task's end one for each shingle of its summary of frequent ones."""
    kinds = (pa.int32(), *[pa.int64()] * 5)
    token, count = np.empty(0, np.uint64), np.empty(0, np.int64)

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "doc_id", "row_key", "n", "d1", "d2"])

    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(strings(part.column(2)))
            digests = [_digest(s) if len(s) else (0, 0) for s in sets]
            distinct = dict(zip(digests, sets, strict=True)).values()
            token, count = _kept_counts(token, count, *np.unique(np.concatenate([*distinct, np.empty(0, np.uint64)]), return_counts=True), SUMMARY)
            yield rows([0] * len(sets), part.column(0), part.column(1), [len(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests])
    none = np.zeros(len(token), np.int64)
    yield rows(none + 1, [None] * len(token), _signed(token), count, none, none)
    pa.default_memory_pool().release_unused()


def _counted(batch: pa.RecordBatch) -> Iterator[dict]:
    """How many of the sets hold each shingle that comes early by hash."""
    sets = shingle_sets(strings(batch.column(1)))
    token, n = np.unique(np.concatenate([*(s[: np.searchsorted(s, LOW)] for s in sets), np.empty(0, np.uint64)]), return_counts=True)
    yield {"token": _signed(token), "n": n}


def frequent_levels(survey: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their levels: those of the summaries, and those that several documents of the sample hold."""
    seen = survey.where("kind = 1").groupBy(F.col("row_key").alias("token")).agg(F.sum("n").alias("n"))
    part = map_arrow(sample, _counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    both = seen.unionByName(part.withColumn("n", F.col("n") * COUNTED)).groupBy("token").agg(F.max("n").alias("n"))
    levels = cut(both.select("token", F.ceil(F.log2(F.col("n") + 1.0)).cast("int").alias("level")))
    least, total = 128, 0
    for row in levels.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # a row for each level
        if (total := total + row.k) > FREQUENT:
            break
        least = row.level
    found = levels.where(F.col("level") >= least).toArrow()
    forget(levels)
    tokens = found["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = tokens.argsort()
    return tokens[order], found["level"].to_numpy().astype(np.int8)[order]


def needed(n: np.ndarray | int, m: np.ndarray | int):
    """The least overlap of sets of these sizes that reaches 0.75."""
    return (3 * (n + m) + 6) // 7


class Orders:
    """The global orders of tokens, and the prefixes that they give."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        self.tokens, self.levels = tokens, levels

    def level(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int8)
        if len(self.tokens):
            i = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
            hit = self.tokens[i] == s
            out[hit] = self.levels[i[hit]]
        return out

    def first(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix under the first order, in order, and which of its tokens have a level."""
        level = self.level(s)
        i = np.lexsort((s, level))[: prefix_length(len(s))]
        return s[i], level[i] > 0

    def second(self, s: np.ndarray) -> np.ndarray:
        return np.sort(s[np.lexsort((s * np.uint64(SECOND), self.level(s)))[: prefix_length(len(s))]])

    def third(self, s: np.ndarray) -> np.ndarray:
        k = prefix_length(len(s))
        return np.sort(s[np.argpartition(s * np.uint64(THIRD), k - 1)[:k]])


def prefix_length(n: int) -> int:
    """So many tokens that a set of n can't reach the threshold with another set without sharing one of them."""
    return n - (3 * n + 3) // 4 + 1


def _postings(orders: Orders):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("token", "id", "n", "pos", "frequent")}
        for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(strings(batch.column(1))), strict=True):
            if not len(s):
                continue
            token, frequent = orders.first(s)
            k = len(token)
            out["token"].append(_signed(token))
            out["id"].append(np.full(k, doc_id, np.int64))
            out["n"].append(np.full(k, len(s), np.int32))
            out["pos"].append(np.arange(k, dtype=np.int32))
            out["frequent"].append(frequent)
        if out["token"]:
            yield {k: np.concatenate(v) for k, v in out.items()}

    return run


def _sets(orders: Orders):
    """Members, and prefixes under the further orders in half the bits: a chance hit there only costs a test."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = shingle_sets(strings(batch.column(1)))
        short = lambda s: (s >> np.uint64(32)).astype("<u4").tobytes()
        yield {"id": batch.column(0), "n": [len(s) for s in sets], "parities": [parities(s).tobytes() for s in sets], "second": [short(orders.second(s)) if len(s) else b"" for s in sets], "third": [short(orders.third(s)) if len(s) else b"" for s in sets], "members": [s.tobytes() for s in sets]}

    return run


PAIR = ("a", "b", "label_a", "label_b")
PAIRS = ", ".join(f"{c} long" for c in PAIR)


def _passing(batch: pa.RecordBatch, keep: list[bool]) -> dict:
    mask = pa.array(keep, pa.bool_())
    return {c: batch.column(c).filter(mask) for c in PAIR}


def parities(s: np.ndarray) -> np.ndarray:
    """A few bits for each member: whether an odd number of members fall in each place."""
    places = 4 << max(4, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8))


def may_link(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """False if the places of different parity show that too few members are common; these are in one of the sets only."""
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    if len(x) > len(y):
        x, y = y, x
    odd = int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())
    return (n + m - odd) // 2 >= needed(n, m)


FILTERS = ("n", "second", "third", "parities")


def _share(batch: pa.RecordBatch) -> Iterator[dict]:
    """Pairs whose prefixes share a token under the second order and under the third, and whose parities leave room for the overlap."""
    bits, ids = (lambda p: np.frombuffer(p, np.uint8)), (lambda p: np.frombuffer(p, "<u4"))
    rows = zip(*(batch.column(c + side).to_pylist() for c in FILTERS for side in ("", "_")), strict=True)
    yield _passing(batch, [np.isin(ids(p), ids(q)).any() and np.isin(ids(r), ids(s)).any() and may_link(n, bits(x), m, bits(y)) for n, m, p, q, r, s, x, y in rows])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union."""
    n, m = len(x), len(y)
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 75 * (n + m - common)


def _verify(batch: pa.RecordBatch) -> Iterator[dict]:
    sets = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
    yield _passing(batch, [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets])


def narrowed(df: DataFrame, keys: DataFrame, column: str, n_keys: int) -> DataFrame:
    """df's rows whose column is among the keys; these are broadcast while few."""
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys, column, "left_semi")


#: Sets of one side of pairs are broadcast up to so many bytes of members.
BROADCAST_BYTES = 8 << 20


def met(pairs: DataFrame, sets: DataFrame, ours: list, theirs: list) -> DataFrame:
    """Pairs (a, b) with columns of both sets. Few pairs are broadcast, so that only sets of documents in a pair move; if those of
    a are small in all, they are broadcast as well, and none moves."""
    left, few = pairs.select("a"), pairs.count() <= BROADCAST_ROWS
    if few:
        pairs, left = F.broadcast(pairs), F.broadcast(left)
    y = sets.select(F.col("id").alias("b"), *theirs).join(pairs, "b")
    x = sets.select(F.col("id").alias("a"), *ours).join(left, "a", "left_semi")
    members = sets.select(F.col("id").alias("a"), F.col("n").alias("members_n")).join(left, "a", "left_semi").agg(F.sum("members_n")).first()[0] if few else None
    return y.join(F.broadcast(x) if few and 8 * (members or 0) <= BROADCAST_BYTES else x, "a")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs that link: first what all orders let pass, then by the members."""
    met_here = met(pairs, sets, [F.col(c) for c in FILTERS], [F.col(c).alias(f"{c}_") for c in FILTERS])
    candidates = cut(map_arrow(met_here.select(*PAIR, *(c + side for c in FILTERS for side in ("", "_"))), _share, PAIRS))
    whole = met(candidates, sets, [F.col("members").alias("x")], [F.col("members").alias("y")])
    found = cut(map_arrow(whole.select(*PAIR, "x", "y"), _verify, PAIRS))
    forget(candidates)
    return found


#: Sizes and positions that leave room for the overlap that the threshold asks for, (n, pos) against (n_, pos_).
IN_PLACE = "4 * least(n, n_) >= 3 * greatest(n, n_) and pos <= n - (3 * (n + n_) + 6) div 7 and pos_ <= n_ - (3 * (n + n_) + 6) div 7"


#: Tokens of fewer sharers go without rounds: their pairs are few.
CROWD = 16


def _live(shared: DataFrame) -> DataFrame:
    """Postings of tokens whose sharers have several labels, each with the token's commonest label."""
    per = shared.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label", True).alias("major"))
    return shared.join(per.where("low <> high").select("token", "major"), "token")


def _first_tests(shared: DataFrame) -> DataFrame:
    """One pair a document: of the most shared documents of its tokens, that which it shares most with. All stand alone yet."""
    most = Window.partitionBy("token").orderBy(F.desc("score"), "id")
    rows = shared.withColumn("first", F.first(F.struct("id", "n", "pos")).over(most))
    rows = rows.select("token", "id", "n", "pos", "weight", *[F.col(f"first.{c}").alias(f"{c}_") for c in ("id", "n", "pos")])
    pairs = rows.where(f"id <> id_ and {IN_PLACE}").groupBy(F.col("id_").alias("a"), F.col("id").alias("b")).agg(F.sum("weight").alias("k"))
    pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("k", F.xxhash64("a"))).alias("a"))
    return cut(pairs.select("a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b")))


def _more_tests(live: DataFrame, step: int) -> DataFrame:
    """Pairs of a round: b shares a token in place with a, a chosen document of the token's commonest label."""
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("id", F.lit(step)), "id"))
    pivots = live.where("label = major").withColumn("place", place).where(F.col("place") <= PIVOTS[step])
    pivots = pivots.select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "pos", "label")])
    # a document needs to meet a component's chosen ones in one of their tokens only
    one = F.min_by(F.struct("token", "n", "pos", "label"), F.xxhash64("token", F.lit(step)))
    others = live.where("label <> major").groupBy("id", "major").agg(one.alias("x")).select("id", "x.*")
    pairs = others.join(pivots, "token").where(IN_PLACE)
    return cut(pairs.select(F.col("id_").alias("a"), F.col("id").alias("b"), F.col("label_").alias("label_a"), F.col("label").alias("label_b")).distinct())


def _relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Gives documents the label that one of their label was found linked to. Labels that others lead to stay, so that none go in
    circles: documents of one label surely are of one component, but not the other way round."""
    leads = found.groupBy(F.col("label_b").alias("label")).agg(F.min("label_a").alias("new"))
    leads = cut(leads.join(found.select(F.col("label_a").alias("label")).distinct(), "label", "left_anti"))
    rows = rows.drop("major").join(F.broadcast(leads) if leads.count() <= BROADCAST_ROWS else leads, "label", "left")
    now = cut(_live(rows.withColumn("label", F.coalesce("new", "label")).drop("new")))
    forget(leads)
    return now


def _labelled(shared: DataFrame, links: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """shared with the labels of components, and these (id, label)."""
    if not links:
        return shared.withColumn("label", F.col("id")), None
    edges = links[0].select("a", "b")
    for more in links[1:]:
        edges = edges.unionByName(more.select("a", "b"))
    labels = components(edges)
    rows = shared.join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "id", "left")
    return rows.withColumn("label", F.coalesce("label", "id")), labels


def one_token_each(shared: DataFrame) -> DataFrame:
    """Of tokens with the same sharers the first in the order, with their number as weight. All documents order tokens alike, so the
    first has the smallest place in each, and a pair that any of them lets pass in place passes by it, too."""
    per = shared.groupBy("token").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in range(2)], F.min("pos").alias("first")).where("k > 1")
    chosen = per.groupBy("k", "x0", "x1").agg(F.min_by("token", "first").alias("token"), F.count("*").alias("weight")).select("token", "weight")
    return shared.join(chosen, "token")


def link_classes(shared: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Component labels (id, label) of linked classes; shared holds (token, id, n, pos, weight)."""
    degree = shared.groupBy("id").agg((F.sum("weight") / F.max("n")).alias("score"))
    pairs = _first_tests(shared.join(degree, "id"))
    links = [verified(pairs, sets)]
    forget(pairs)
    crowds = cut(shared.groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") >= CROWD).select("token"))
    crowded = shared.join(F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds, "token", "left_semi")
    live = _relabelled(crowded.withColumn("label", F.col("id")), links[0])
    for step in range(1, len(PIVOTS)):
        pairs = _more_tests(live, step)
        links.append(verified(pairs, sets))
        before, live = live, _relabelled(live, links[-1])
        forget(pairs, before)
    forget(live, crowds)
    # all pairs of different components that share a token in place; one of the two is outside the token's commonest component
    rows, labels = _labelled(shared, links)
    rows = _live(rows)
    minor = rows.where("label <> major").select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "pos", "label")])
    rest = rows.join(minor, "token").where(f"label <> label_ and {IN_PLACE}").select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
    rest = cut(rest.withColumns({"label_a": F.lit(0).cast("long"), "label_b": F.lit(0).cast("long")}))
    found = verified(rest, sets)
    if not found.isEmpty():
        labels = _labelled(shared, [*links, found])[1]
    forget(rest, found, *links)
    return labels


def near_duplicate_components(docs: DataFrame, salts: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"))
    survey = cut(rows.mapInArrow(_survey, SURVEY))
    each = survey.where("kind = 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(salts)))
    part = each.where("n > 0").groupBy("d1", "d2", "salt").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("x"))
    classes = cut(part.groupBy("d1", "d2").agg(F.min("x").alias("x"), F.collect_list("salt").alias("salts")).select("d1", "d2", F.col("x.doc_id").alias("id"), F.col("x.row_key").alias("row_key"), "salts"))
    chosen = classes.where("id is not null").select("row_key")
    one_each = narrowed(rows, chosen, "row_key", chosen.count()).select("doc_id", "text")
    counted = chosen.where(F.pmod(F.xxhash64("row_key"), F.lit(COUNTED)) == 0)
    orders = Orders(*frequent_levels(survey, narrowed(rows, counted, "row_key", counted.count()).select("doc_id", "text")))
    postings = map_arrow(one_each, _postings(orders), "token long, id long, n int, pos int, frequent boolean")
    # a token's sharers are counted where they meet; frequent tokens are dealt out, for they surely have sharers
    dealt = postings.withColumn("deal", F.when(F.col("frequent"), F.pmod("id", F.lit(256))).otherwise(0))
    met_once = cut(dealt.withColumn("k", F.count("*").over(Window.partitionBy("token", "deal"))).where("k > 1 or frequent").select("token", "id", "n", "pos"))
    shared = cut(one_token_each(met_once))
    forget(met_once)
    ids = cut(shared.select(F.col("id").alias("doc_id")).distinct())
    sets = cut(map_arrow(narrowed(one_each, ids, "doc_id", ids.count()), _sets(orders), "id long, n int, parities binary, second binary, third binary, members binary"))
    labels = link_classes(shared, sets)
    forget(shared, sets, ids)
    whole = classes.select("d1", "d2", F.col("id").alias("component_id"), F.explode("salts").alias("salt"))
    if labels is not None:
        whole = whole.join(labels.withColumnRenamed("id", "component_id"), "component_id", "left").withColumn("component_id", F.coalesce("label", "component_id")).drop("label")
    some = each.where("n > 0").join(whole, ["d1", "d2", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id. Rows without doc_id, or with one that several rows have,
    count as documents of their own, under numbers below zero that stand for doc_id and text, and stay before others; of those
    that agree in both one stays. Null and empty texts all stay, but for such repeated rows."""
    name = "_" * (1 + max(map(len, docs.columns))) + "row"  # a name that no column of docs has
    often = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(f"{name}_id"))
    often = cut(often)
    stands = -1 - F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))), 1)
    named = docs.withColumn(name, F.col("doc_id").cast("long"))
    if not often.isEmpty():
        same = docs["doc_id"].eqNullSafe(often[f"{name}_id"])
        few = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
        alone = docs.join(few, same, "left_anti").withColumn(name, F.col("doc_id").cast("long"))
        named = alone.unionByName(docs.join(few, same, "left_semi").withColumn(name, stands).dropDuplicates([name]))
    found = near_duplicate_components(named.select(F.col(name).alias("doc_id"), "text"))
    dropped = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return named.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, name, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(a[i:i + 4], ' ')) AS s FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM w WHERE len(a) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""
