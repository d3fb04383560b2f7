"""Byte-pair encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of every distinct word of a batch at once; a test over all adjacent token pairs
finds the words where the proposal is what merging by rank gives; only the others are merged exactly. Words are split
off by array operations over code points and looked up by a 64-bit hash, so that a frequent word costs one lookup.

Null and empty texts have no tokens; special-token strings in a text give their own id, as the tokenizers library does
by default; very long texts are cut at places where a word surely begins."""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, strings, table, text_groups
from .ngram_join import mix

#: The apostrophe endings that the vocabulary's word pattern splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The white space of Unicode.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: Words kept by a worker between batches; beyond that the store starts anew.
STORE_WORDS = 1_000_000
#: Longer words, in bytes, are matched and merged one by one.
LONG_WORD = 200


@lru_cache(1)
def char_classes() -> np.ndarray:
    import unicodedata

    first = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
    first[SPACES] = SPACE
    return first


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the tables that the tests on pairs need. Merged tokens must have ids in merge order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back = byte_of_char()
        vocab = model["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.id = {b: i for i, b in self.bytes.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        n = max(self.bytes) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.order = np.full(n, -1)  # merge rank of a token, -1 for single bytes
        for r, (a, b) in enumerate(merges):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((i, j), (r, k))
            if self.order[k] < 0:
                self.left[k], self.right[k], self.order[k] = i, j, r
        pairs = np.array([(i << 32 | j, r) for (i, j), (r, _) in self.rank.items()], np.int64)
        pairs = pairs[pairs[:, 0].argsort()]
        self.pair_key, self.pair_rank = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.makes = np.zeros(len(merges), np.int64)
        for r, k in self.rank.values():
            self.makes[r] = k
        self.byte_id = np.array([self.id[bytes([b])] for b in range(256)])
        self.text = [self.bytes.get(i, b"") for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        # tokens that merging by rank never makes of their own bytes can't be proposed
        good = {b: i for b, i in self.id.items() if len(b) == 1 or self.merge(b) == [i]}
        self.longest = max(map(len, good))
        self.good = good
        self._trie(good)
        self.tested: dict[str, np.ndarray] = {"key": np.empty(0, np.int64), "ok": np.empty(0, bool)}

    def _trie(self, good: dict[bytes, int]) -> None:
        state = {b"": 0}
        for token in sorted(good, key=len):
            for n in range(1, len(token) + 1):
                state.setdefault(token[:n], len(state))
        edges = np.array([(state[p[:-1]] << 8 | p[-1], s) for p, s in state.items() if p], np.int64)
        edges = edges[edges[:, 0].argsort()]
        self.edge_key, self.edge_to = edges[:, 0].copy(), edges[:, 1].copy()
        self.accepts = np.full(len(state), -1)
        for token, i in good.items():
            self.accepts[state[token]] = i
        self.root = np.full(256, -1)
        at = self.edge_key < 256
        self.root[self.edge_key[at]] = self.edge_to[at]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals first."""
        ids = [self.id[word[i : i + 1]] for i in range(len(word))]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of words of similar lengths side by side: each round joins the lowest-ranked pair of every word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        done = 0
        for width in (8, 12, 16, 24, 40, LONG_WORD):
            rows = np.flatnonzero((lengths > done) & (lengths <= width))
            done = width
            for part in np.array_split(rows, max(1, len(rows) * width // 500_000)):
                if len(part):
                    grid = np.zeros((len(part), width), np.uint8)
                    inside = np.arange(width) < lengths[part, None]
                    grid[inside] = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
                    for i, ids in zip(part.tolist(), self._merge_grid(self.byte_id[grid], inside), strict=True):
                        out[i] = ids
        return out

    def _merge_grid(self, ids: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        none = 1 << 50
        ids = np.where(inside, ids, -1)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        size = inside.sum(1)
        live, cols = np.arange(len(ids)), np.arange(ids.shape[1])
        while len(live):
            at = rank[live].argmin(1)
            live, at = live[hit := rank[live, at] < none], at[hit]
            if not len(live):
                break
            row, rk = ids[live], rank[live]
            made = self.makes[rk[np.arange(len(live)), at]]
            row = np.where(cols <= at[:, None], row, np.concatenate([row[:, 1:], np.full((len(row), 1), -1)], 1))
            rk = np.where(cols[:-1] <= at[:, None], rk, np.concatenate([rk[:, 1:], np.full((len(rk), 1), none)], 1))
            here = np.arange(len(live))
            row[here, at] = made
            for shift in (-1, 0):
                k = at + shift
                ok = (k >= 0) & (k + 1 < row.shape[1])
                rk[here[ok], k[ok]] = self._ranks(row[here[ok], k[ok]], row[here[ok], k[ok] + 1])
            ids[live], rank[live] = row, rk
            size[live] -= 1
        return [x[:n] for x, n in zip(ids, size.tolist(), strict=True)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | (b & 0xFFFFFFFF)
        i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[i] == key) & (b >= 0), self.pair_rank[i], 1 << 50)

    def propose_long(self, word: bytes) -> list[int]:
        out, at = [], 0
        while at < len(word):
            n = min(self.longest, len(word) - at)
            while word[at : at + n] not in self.good:
                n -= 1
            out.append(self.good[word[at : at + n]])
            at += n
        return out

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words side by side: word numbers and tokens, in order."""
        words, tokens = [], []
        at = starts.copy()
        live = np.flatnonzero(at < ends)
        while len(live):
            pos, stop = at[live], ends[live]
            state = self.root[data[pos]]
            best, best_end = self.accepts[state], pos + 1
            depth, walk = pos + 1, np.flatnonzero(pos + 1 < stop)
            while len(walk):
                key = state[walk] << 8 | data[depth[walk]]
                i = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
                walk, i = walk[hit := self.edge_key[i] == key], i[hit]
                state[walk] = self.edge_to[i]
                depth[walk] += 1
                won = walk[self.accepts[state[walk]] >= 0]
                best[won], best_end[won] = self.accepts[state[won]], depth[won]
                walk = walk[depth[walk] < stop[walk]]
            words.append(live)
            tokens.append(best)
            at[live] = best_end
            live = live[best_end < stop]
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w, t = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens, whether merging by rank keeps the border between them.

        Both tokens are taken apart in reverse merge order. Whenever the pieces that touch at the border could have been
        joined before the merge undone last, that join would have come first and the border would be gone."""
        key = a.astype(np.int64) << 32 | b
        uniq, back = np.unique(key, return_inverse=True)
        i = np.minimum(np.searchsorted(self.tested["key"], uniq), max(0, len(self.tested["key"]) - 1))
        known = self.tested["key"][i] == uniq if len(self.tested["key"]) else np.zeros(len(uniq), bool)
        fresh = uniq[~known]
        if len(fresh):
            ok = self._compatible(fresh >> 32, fresh & 0xFFFFFFFF)
            if len(self.tested["key"]) > 4 * STORE_WORDS:
                self.tested = {"key": uniq[:0], "ok": np.empty(0, bool)}
                return self.compatible(a, b)
            keys, oks = np.concatenate([self.tested["key"], fresh]), np.concatenate([self.tested["ok"], ok])
            order = np.argsort(keys, kind="stable")
            self.tested = {"key": keys[order], "ok": oks[order]}
            i = np.searchsorted(self.tested["key"], uniq)
        return self.tested["ok"][i][back]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        # the border must outlive all merges before (rank, side): a join wins ties against later ranks only
        limit = np.full(len(a), 1 << 50)
        live = np.arange(len(a))
        while len(live):
            key = a[live] << 32 | b[live]
            i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[i] == key, self.pair_rank[i], 1 << 50)
            # twice the rank, plus one where the undone merge stands left of the border and so comes first at equal rank
            bad = 2 * rank < limit[live]
            ok[live[bad]] = False
            live = live[~bad]
            ra, rb = self.order[a[live]], self.order[b[live]]
            done = (ra < 0) & (rb < 0)
            live, ra, rb = live[~done], ra[~done], rb[~done]
            undo_left = ra > rb  # at equal rank the left merge came first, so the right one is undone first
            l, r = live[undo_left], live[~undo_left]
            # the left token's last merge starts left of the border join: at equal rank the merge came first
            limit[l] = 2 * ra[undo_left]
            limit[r] = 2 * rb[~undo_left] + 1
            a[l] = self.right[a[l]]
            b[r] = self.left[b[r]]
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words in a row, the number of each word's, and how many words needed exact merging."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = lengths.cumsum()
        data = np.frombuffer(b"".join(words), np.uint8)
        short = lengths <= LONG_WORD
        where = np.flatnonzero(short)
        w, t = self.propose(data, (ends - lengths)[where], ends[where])
        w = where[w]
        for i in np.flatnonzero(~short):
            got = self.propose_long(words[i])
            w, t = np.concatenate([w, np.full(len(got), i)]), np.concatenate([t, np.array(got, np.int64)])
        if not short.all():
            order = np.argsort(w, kind="stable")
            w, t = w[order], t[order]
        same = w[1:] == w[:-1]
        bad = np.unique(w[1:][same][~self.compatible(t[:-1][same], t[1:][same])])
        counts = np.bincount(w, minlength=len(words))
        if len(bad):
            some = [words[i] for i in bad]
            exact = [x if x is not None else np.array(self.merge(y), np.int64) for x, y in zip(self.merge_many(some), some, strict=True)]
            wrong = np.zeros(len(words), bool)
            wrong[bad] = True
            keep = ~wrong[w]
            w = np.concatenate([w[keep], np.repeat(bad, [len(x) for x in exact])])
            t = np.concatenate([t[keep], *exact])
            order = np.argsort(w, kind="stable")
            w, t = w[order], t[order]
            counts = np.bincount(w, minlength=len(words))
        return t, counts, len(bad)


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of many runs, one after another."""
    ends = lengths.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def split_words(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts of the words of the vocabulary's pattern; codes begin and end with a mark of class END."""
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == END
    run = np.flatnonzero(start)
    # white space: the last of a run stands apart unless the text ends there, and a blank joins what follows
    is_space = kind[run] == SPACE
    last = np.append(run[1:], n) - 1
    last = last[is_space]
    last = last[kind[last + 1] != END]
    start[last] = True
    blank = last[codes[last] == 0x20]
    start[blank + 1] = False
    # endings after an apostrophe: not where a blank has joined it
    mark = np.flatnonzero((codes == 0x27) & start)
    if len(mark):
        for e in ENDINGS:
            at = mark[mark + len(e) < n]
            for k, c in enumerate(e):
                at = at[codes[at + 1 + k] == ord(c)]
            start[at + 1] = False
            rest = at[kind[at + 1 + len(e)] == LETTER] + 1 + len(e)
            start[rest] = True
    return np.flatnonzero(start)


#: A random number for each ASCII character at each of 256 places of a word; a word's hash adds up those of its characters, so
#: that no two words are alike by construction, as they can be under a polynomial modulo a power of two.
CHAR_AT_PLACE = mix(mix(np.arange(1, (256 << 7) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def char_values(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    value = CHAR_AT_PLACE[(place & 255) << 7 | (codes & 127)]
    rare = np.flatnonzero((codes > 127) | (place > 255))
    if len(rare):
        value[rare] = mix(value[rare] + (codes[rare] >> 7).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (place[rare] >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return value


class Encoder:
    """Encodes lists of texts; keeps the tokens of words met before."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.kinds = char_classes()
        self.merged = 0
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.begin, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
        for a, b in text_groups([p for _, p in parts]):
            for (i, _), ids in zip(parts[a:b], self._encode([p for _, p in parts[a:b]]), strict=True):
                out[i].append(ids)
        return [x[0] if len(x) == 1 else np.concatenate([np.empty(0, np.int32), *x]) for x in out]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        v = self.vocabulary
        marks: list[int] = []  # ids of special tokens, in order
        plain: list[str] = []
        sizes = []
        for t in texts:
            found: list = [t]
            for s, i in v.special.items():
                if s in t:
                    found = [y for x in found for y in (self._around(x, s, i) if isinstance(x, str) else [x])]
            segments, ids = [], []
            for x in found:
                (segments if isinstance(x, str) else ids).append(x)
            plain += segments
            marks += [*ids, -1]
            sizes.append(len(segments))
        # every segment is followed by one mark: a special token or the text's end
        big = "\0" + "\0".join(plain) + "\0"
        codes = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[codes]
        stops = np.fromiter((len(p) + 1 for p in plain), np.int64, len(plain)).cumsum()
        kind[0] = END
        kind[stops] = END
        start = split_words(codes, kind)
        lengths = np.diff(np.append(start, len(codes)))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(char_values(codes, np.arange(len(codes)) - np.repeat(start, lengths)), out=sums[1:])
        hashes = mix(sums[start + lengths] - sums[start] + lengths.astype(np.uint64))
        real = kind[start] != END
        uniq, first, back = np.unique(hashes[real], return_index=True, return_inverse=True)
        self._learn(big, uniq, start[real][first], lengths[real][first])
        i = np.searchsorted(self.hashes, uniq)
        counts = np.zeros(len(start), np.int64)
        begins = np.zeros(len(start), np.int64)
        counts[real], begins[real] = self.count[i][back], self.begin[i][back]
        # marks: special tokens count one
        mark = np.array(marks, np.int64)
        at = np.flatnonzero(~real)[1:]
        counts[at] = mark >= 0
        ids = np.empty(counts.sum(), np.int32)
        ends = counts.cumsum()
        words = np.flatnonzero(real)
        ids[spans(counts[words], (ends - counts)[words])] = self.pool[spans(counts[words], begins[words])]
        ids[(ends - 1)[at[mark >= 0]]] = mark[mark >= 0]
        return np.split(ids, ends[at[mark < 0]])[: len(texts)]

    @staticmethod
    def _around(text: str, special: str, i: int) -> list:
        out: list = []
        for k, x in enumerate(text.split(special)):
            out += [i, x] if k else [x]
        return out

    def _learn(self, big: str, uniq: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        if len(self.hashes) + len(uniq) > STORE_WORDS and len(self.hashes):
            self._reset()
        i = np.searchsorted(self.hashes, uniq)
        fresh = np.ones(len(uniq), bool)
        if len(self.hashes):
            fresh = self.hashes[np.minimum(i, len(self.hashes) - 1)] != uniq
        if not fresh.any():
            return
        words = [big[s : s + n].encode("utf-8", "surrogatepass") for s, n in zip(start[fresh].tolist(), length[fresh].tolist(), strict=True)]
        tokens, counts, merged = self.vocabulary.encode_words(words)
        self.merged += merged
        ends = counts.cumsum()
        self.hashes = np.insert(self.hashes, i[fresh], uniq[fresh])
        self.begin = np.insert(self.begin, i[fresh], ends - counts + len(self.pool))
        self.count = np.insert(self.count, i[fresh], counts)
        self.pool = np.concatenate([self.pool, tokens.astype(np.int32)])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.text.__getitem__, ids.tolist())).decode("utf-8", "replace")


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cuts a very long text before blanks that stand between two characters other than white space."""
    while len(text) > size:
        at = text.rfind(" ", 0, size)
        while at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.rfind(" ", 0, at)
        if at <= 0 or "<|" in text[max(0, at - 40) : at + 40]:
            break
        yield text[:at]
        text = text[at:]
    yield text


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; null text counts as empty."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        e, texts = encoder(path), strings(batch.column(1))
        for a, b in text_groups(texts, 4 << 20):
            ids = e.encode(texts[a:b])
            yield {"doc_id": batch.column(0)[a:b], "ids": ids, "decoded": [e.decode(x) for x in ids]}

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without moving the ids out of the worker."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        e, texts = encoder(path), strings(batch.column(1))
        for a, b in text_groups(texts, 4 << 20):
            ids = e.encode(texts[a:b])
            yield {
                "doc_id": batch.column(0)[a:b],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(e.vocabulary.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(e.decode(x).encode()).hexdigest() for x in ids],
            }

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
