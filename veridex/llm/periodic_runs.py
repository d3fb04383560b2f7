"""Periodic runs of words by block convolution.

The words of many documents stand in one array, numbered so that two documents share none. At each scale B = 1, 2, 4, ... the
array is cut into blocks of B words. The sum of squared differences between a block and each place B to 2B - 1 words further
on comes from number-theoretic transforms in exact integers; where it is zero, the block occurs again, and that distance seeds
a run, which is then extended to both sides. A run of period q has at least 4q words, so at the scale B <= q < 2B some whole
block of it is followed by its copy q words on: no run is missed, and no pair of places is listed.

A block is convolved only if it can occur again: the next occurrence of each of its words must be less than 2B words away. A
block that stands with its window in a known run of a smaller period is passed over, because any distance there would be a
multiple of that period. Sums are taken modulo a prime and may vanish by accident, extensions compare hashes; so each run is
compared word by word in the end."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Fixed values of the transforms: a prime with 2^23 | PRIME - 1, and a generator of its residues.
PRIME, GENERATOR = 998_244_353, 3
#: Blocks are transformed in groups of about this many numbers.
GROUP = 1 << 19
#: Two primes and bases of the hashes that extensions compare.
HASHES = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
LEAST, TIMES = 6, 4


def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for each stage, largest first."""
    out = []
    while size > 1:
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        powers = np.ones(size // 2, np.uint64)
        done = 1
        while done < size // 2:
            powers[done : 2 * done] = powers[:done][: size // 2 - done] * np.uint64(pow(root, done, PRIME)) % PRIME
            done *= 2
        out.append(powers)
        size //= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row, in bit-reversed order; a row's length is a power of two."""
    n, size = rows.shape
    for powers in _roots(size, False):
        half = len(powers)
        x = rows.reshape(n, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        rows = np.stack([(a + b) % PRIME, (a + PRIME - b) % PRIME * powers % PRIME], axis=2).reshape(n, size)
    return rows


def back(rows: np.ndarray) -> np.ndarray:
    """The inverse of transform."""
    n, size = rows.shape
    for powers in reversed(_roots(size, True)):
        x = rows.reshape(n, -1, 2, len(powers))
        a, b = x[:, :, 0], x[:, :, 1] * powers % PRIME
        rows = np.stack([(a + b) % PRIME, (a + PRIME - b) % PRIME], axis=2).reshape(n, size)
    return rows * np.uint64(pow(size, PRIME - 2, PRIME)) % PRIME


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where the squared differences of a block and its window sum to zero (modulo the prime): rows of B truth values for
    blocks of B numbers and windows of 2B - 1."""
    size = blocks.shape[1]
    turned = np.zeros((len(blocks), 2 * size), np.uint64)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]
    text = np.zeros((len(blocks), 2 * size), np.uint64)
    text[:, :-1] = windows
    product = back(transform(turned) * transform(text) % PRIME)[:, :size]
    square = windows.astype(np.uint64) ** 2 % PRIME
    sums = np.concatenate([np.zeros((len(blocks), 1), np.uint64), np.cumsum(square, axis=1)], axis=1)
    own = (blocks.astype(np.uint64) ** 2 % PRIME).sum(axis=1, keepdims=True)
    return (own + sums[:, size:] - sums[:, :size] + 2 * (PRIME - product)) % PRIME == 0


class Extender:
    """How far equality at a distance goes on, by hashes of stretches."""

    def __init__(self, words: np.ndarray):
        self.n, self.sums, self.powers = len(words), [], []
        for prime, base in HASHES:
            powers = np.ones(max(1, self.n), np.uint64)
            done = 1
            while done < self.n:
                powers[done : 2 * done] = powers[:done][: self.n - done] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
                done *= 2
            total = np.cumsum(powers[: self.n] * words.astype(np.uint64) % np.uint64(prime))  # below 2^31 each, so no overflow
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), total]))
            self.powers.append(powers)

    def equal(self, start: np.ndarray, end: np.ndarray, distance: np.ndarray) -> np.ndarray:
        out = np.ones(len(start), bool)
        for (prime, _), sums, powers in zip(HASHES, self.sums, self.powers, strict=True):
            here = (sums[end] - sums[start]) % np.uint64(prime) * powers[distance] % np.uint64(prime)
            out &= here == (sums[end + distance] - sums[start + distance]) % np.uint64(prime)
        return out

    def extend(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest stretch around each place where a word equals the one distance further on: its start and its end."""
        out = []
        for sign in (-1, 1):
            low, high = np.zeros_like(at), (at if sign < 0 else self.n - distance - at)
            while (low < high).any():
                mid = (low + high + 1) // 2
                same = self.equal(at - mid, at, distance) if sign < 0 else self.equal(at, at + mid, distance)
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            out.append(at + sign * low)
        return out[0], out[1]


def next_gaps(words: np.ndarray) -> np.ndarray:
    """The distance of each word's next occurrence; a great number if there is none."""
    order = np.argsort(words, kind="stable")
    gaps = np.full(len(words), np.iinfo(np.int64).max)
    same = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in order of start and period. words: numbers from 1; longest: no run is longer."""
    words = words.astype(np.int64)
    n, gaps, extender = len(words), next_gaps(words), None
    found: dict[tuple[int, int], int] = {}
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = 1
    while TIMES * size <= longest and n // size:
        at = np.flatnonzero(gaps[: n // size] < 2 * size) * size  # gaps holds the greatest gap of each block
        if len(starts) and len(at):
            k = np.searchsorted(starts, at, "right")
            at = at[(k == 0) | (reach[np.maximum(k - 1, 0)] < at + 3 * size)]
        new = []
        for group in np.array_split(at, min(len(at), 1 + len(at) * 2 * size // GROUP)) if len(at) else ():
            padded = np.minimum(group[:, None] + np.arange(3 * size - 1), n)
            around = np.append(words, 0)[padded]
            row, shift = np.nonzero(occurrences(around[:, :size], around[:, size:]))
            if not len(row):
                continue
            extender = extender or Extender(words)
            distance = shift + size
            inside = group[row] + distance < n
            place, distance = group[row][inside], distance[inside]
            start, end = extender.extend(place, distance)
            length = end + distance - start
            good = length >= np.maximum(LEAST, TIMES * distance)
            new += np.unique(np.stack([start, length, distance], axis=1)[good], axis=0).tolist()
        for start, length, period in sorted(set(map(tuple, new)), key=lambda x: x[2]):
            if not (np.array_equal(words[start : start + length - period], words[start + period : start + length])):
                raise ArithmeticError("two different stretches have equal hashes")
            found.setdefault((start, length), period)
        if new:
            starts = np.array(sorted(s for s, _ in found), np.int64)
            reach = np.maximum.accumulate(np.array([s + k for s, k in sorted(found)], np.int64))
        size *= 2
        even = gaps[: len(gaps) // 2 * 2]
        gaps = np.maximum(even[::2], even[1::2])
    return sorted((s, k, q) for (s, k), q in found.items())


def damage(doc_id: int | None, words: list) -> list:
    """The words with a period planted where the contract of op11 says so; a row without doc_id stays as it is."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def runs_of(documents: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of these lists of words."""
    numbers, bounds, known = [], [0], 1
    for words in documents:
        own: dict = {}
        numbers += [own.setdefault(w, known + len(own)) for w in words]
        known += len(own)
        bounds.append(len(numbers))
    out: list[list] = [[] for _ in documents]
    runs = find_runs(np.array(numbers, np.int64), max((len(d) for d in documents), default=0))
    of = np.searchsorted(bounds, [s for s, _, _ in runs], "right") - 1
    for (start, length, period), k in zip(runs, of.tolist(), strict=True):
        out[k].append((start - bounds[k], length, period))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _greatest(runs: list[tuple[int, int, int]]) -> tuple | None:
    best = None
    for run in runs:  # in order of start and period, so that ties stay with the first
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(batch: pa.RecordBatch, change) -> Iterable[dict]:
    ids, texts = batch.column(0).to_pylist(), common.strings(batch.column(1))
    for low, high in common.text_groups(texts):
        documents = [change(i, t.encode().split()) for i, t in zip(ids[low:high], texts[low:high], strict=True)]
        found = runs_of(documents)
        best = [_greatest(runs) or (None, None, None) for runs in found]
        yield {
            "doc_id": ids[low:high],
            "n_runs": [len(runs) for runs in found],
            "start": [b[0] for b in best],
            "length": [b[1] for b in best],
            "period": [b[2] for b in best],
            "exponent_milli": [b[1] * 1000 // b[2] if b[2] else None for b in best],
            "runs_sha256": [hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest() for runs in found],
            "collapsed_sha256": [hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest() for w, runs in zip(documents, found, strict=True)],
        }


def periodic_runs(docs: DataFrame, change=lambda doc_id, words: words) -> DataFrame:
    """One row for each row of docs (doc_id, text): the number of runs of its words, the run of the greatest exponent, and
    hashes of all runs and of the text without repeated periods.

    A run is a stretch with smallest period q and max(6, 4q) words or more that can't be made longer. Words are separated by
    the blanks of ASCII. Null and empty texts have no run, rows without doc_id are rows like others, repeated rows each give
    a row, extra columns are ignored. Rows are worked on one by one: nothing is shuffled, and a task holds about half a
    million characters, or one longer text."""
    return common.map_arrow(docs.select("doc_id", "text"), lambda batch: _rows(batch, change), SCHEMA)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with texts whose repeated periods are dropped and whose words are joined by one blank; a text without a run stays
    as it is, null ones too. Other columns stay."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole)):
            place = batch.schema.get_field_index("text")
            column = batch.column(place).to_pylist()
            for low, high in common.text_groups([t or "" for t in column]):
                words = [(t or "").encode().split() for t in column[low:high]]
                column[low:high] = [b" ".join(collapsed(w, runs)).decode() if runs else t for t, w, runs in zip(column[low:high], words, runs_of(words), strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(column, batch.schema.field(place).type))

    return docs.mapInArrow(texts, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.table(spark, sf_dir, "documents"), damage)
