"""Personal data in text, also where it is disguised, with offsets in the original text.

Four kinds are found by plain patterns first (the base spans). A chain of transducers then rewrites disguises (look-alike
and full-width characters, digits of other scripts, spelled digits, "at" and "dot" in words or brackets), each keeping for
every rewritten stretch the source stretch that it stands for. The same patterns run on the result, and what they find is
mapped back; such a span is added where it overlaps no span of its kind.

Null counts as empty and has no spans. Whole texts are read, of any length. Offsets are code points, ends exclusive. Repeated
rows give equal rows; extra columns are ignored. n_email, n_ip, n_card and n_phone count base spans, n_added the others."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, strings, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats find the same matches in linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Spelled digits of English, French, German and Spanish.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Cyrillic and Greek letters and signs that look like ASCII ones.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһԛԝкмтвнАЕОРСУХІЈЅКМТВНοαινρτυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․‐‑‒–—﹒。＿", "aeopcyxijsdhqwkmtbhAEOPCYXIJSKMTBHoaivptukxABEZHIKMNOPTYX.-----.._", strict=True))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        # what lies before this sign is done with: a later match can't begin there
        else:
            end = max(end, at + 1) if start < at else end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base spans."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


class Rewritten:
    """A text with the source stretch of each of its stretches."""

    def __init__(self, text: str):
        self.text = text
        # a stretch begins at .new[i] and stands for the source from .old[i] to .old_end[i]; exact[i]: character by character
        self.new, self.old, self.old_end, self.exact = [0], [0], [len(text)], [True]

    def source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        a = self.old[i] + (start - self.new[i] if self.exact[i] else 0)
        b = self.old[j] + (end - self.new[j]) if self.exact[j] else self.old_end[j]
        return a, b

    def edit(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """The text after edits (start, end, replacement), which are ordered and apart."""
        if not edits:
            return self
        out, parts, size, at = Rewritten(""), [], 0, 0
        out.new, out.old, out.old_end, out.exact = [], [], [], []

        def copy(a: int, b: int) -> None:
            nonlocal size
            i = bisect_right(self.new, a) - 1
            while a < b:
                stop = min(b, self.new[i + 1] if i + 1 < len(self.new) else len(self.text))
                if self.exact[i]:
                    add(stop - a, self.old[i] + a - self.new[i], self.old[i] + stop - self.new[i], True)
                else:
                    add(stop - a, self.old[i], self.old_end[i], False)
                parts.append(self.text[a:stop])
                a, i = stop, i + 1

        def add(n: int, old: int, old_end: int, exact: bool) -> None:
            nonlocal size
            out.new.append(size)
            out.old.append(old)
            out.old_end.append(old_end)
            out.exact.append(exact)
            size += n

        for start, end, put in edits:
            copy(at, start)
            if put:
                add(len(put), *self.source(start, end), False)
                parts.append(put)
            at = end
        copy(at, len(self.text))
        out.text = "".join(parts)
        return out


def _plain(c: str) -> str:
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    d = unicodedata.decimal(c, -1)
    if d >= 0:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and n.isprintable() else c


PLAIN = {ord(k): v for k, v in LOOK_ALIKE.items()} | {i: p for i in range(0x80, 0x20000) if not unicodedata.category(chr(i)).startswith("C") and (p := _plain(chr(i))) != chr(i) and p.isascii()}
HIDDEN = re.compile("[­​-‍⁠﻿]+")
WORD_DIGITS = re.compile(r"(?<![^\W_])(?:(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]+|oh|plus)(?:[\x20,.-]{1,3}|(?![^\W_]))){4,}", re.IGNORECASE)
DIGIT_WORD = r"(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]+|oh)"
SPELLED_PART = DIGIT_WORD + r"(?:[\x20,-]{1,3}" + DIGIT_WORD + r"){0,2}"
SPELLED_IP = re.compile(r"(?<![^\W_])" + SPELLED_PART + r"(?:(?:\s{1,3}dot\s{1,3}|\.)" + SPELLED_PART + r"){3}(?![^\W_])", re.IGNORECASE)
SPELLED_IP_WORD = re.compile(r"[^\W\d_]+|[0-9]+|\.")
ONE_WORD = re.compile(r"[^\W\d_]+|[0-9]+", re.UNICODE)
AT_WORDS, DOT_WORDS = "at|@|arroba|chez", r"dot|punto|point|punkt|\."
BRACKET_AT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:" + AT_WORDS + r")\s{0,3}[\])}>]\s{0,3}", re.IGNORECASE)
BRACKET_DOT = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:" + DOT_WORDS + r")\s{0,3}[\])}>]\s{0,3}", re.IGNORECASE)
#: A dot in the form of a sign, a word or a bracket.
ANY_DOT = r"(?:\s{1,3}dot\s{1,3}|\s{0,3}[\[({<]\s{0,3}(?:" + DOT_WORDS + r")\s{0,3}[\])}>]\s{0,3}|\.)"
SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}(?:" + ANY_DOT + r"[A-Za-z0-9_%+-]{1,64}){0,4}(?P<at>\s{1,3}at\s{1,3}|@)[A-Za-z0-9-]{1,63}(?:" + ANY_DOT + r"[A-Za-z0-9-]{1,63}){0,4}" + ANY_DOT + r"[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.IGNORECASE)
DISGUISED_DOT = re.compile(r"\s+dot\s+|" + BRACKET_DOT.pattern, re.IGNORECASE)
SPOKEN_AT = re.compile(r"\s+at\s+", re.IGNORECASE)
NUMBER_DOT = re.compile(r"(?<=[0-9])\s{1,3}dot\s{1,3}(?=[0-9])", re.IGNORECASE)
NUMBER_WORD = r"(?:" + "|".join(sorted([*SPELLED, "oh", "plus"], key=len, reverse=True)) + ")"
#: What every text that a transducer changes holds: a character beyond ASCII, a bracketed at or dot, a spoken dot, or a number word
#: with another number after it. A run of WORD_DIGITS has three number words at least, of which one is not the last.
HINT = re.compile(r"[^\x00-\x7f]|[\[({<]\s{0,3}(?:" + AT_WORDS + "|" + DOT_WORDS + r")\s{0,3}[\])}>]|\sdot\s|" + r"(?<![^\W_])" + NUMBER_WORD + r"[\x20,.-]{1,3}(?:" + NUMBER_WORD + r"|[0-9])", re.IGNORECASE)


def look_alikes(now: Rewritten) -> Rewritten:
    """Characters that look like ASCII ones. Each becomes one character, so offsets stay; hidden characters go."""
    if now.text.isascii():
        return now
    plain = now.text.translate(PLAIN)
    if plain != now.text:
        now.text = plain
    return now.edit([(*m.span(), "") for m in HIDDEN.finditer(now.text)])


def spelled_digits(now: Rewritten) -> Rewritten:
    edits = []
    for run in SPELLED_IP.finditer(now.text):
        words = [m.group().lower() for m in SPELLED_IP_WORD.finditer(run.group())]
        if "dot" in words and any(w in SPELLED for w in words):
            edits.append((*run.span(), "".join({"oh": "0", "dot": "."}.get(w, SPELLED.get(w, w)) for w in words)))
    now, edits = now.edit(edits), []
    for run in WORD_DIGITS.finditer(now.text):
        pieces = list(ONE_WORD.finditer(now.text, *run.span()))
        if sum(not m.group()[0].isdigit() for m in pieces) < 3:
            continue
        put = "".join({"oh": "0", "plus": "+"}.get(w := m.group().lower(), SPELLED.get(w, w)) for m in pieces)
        edits.append((pieces[0].start(), pieces[-1].end(), put))
    return now.edit(edits)


def at_and_dot(now: Rewritten) -> Rewritten:
    now = now.edit([(*m.span(), "@") for m in BRACKET_AT.finditer(now.text)])
    edits = []
    for m in SPOKEN.finditer(now.text):
        dots = [(x.start(), x.end(), ".") for x in DISGUISED_DOT.finditer(now.text, m.start(), m.end())]
        spoken = SPOKEN_AT.fullmatch(m["at"])
        # a spoken at before a plain host.tld is a disguise only if a dot is disguised, too
        if dots or not spoken:
            edits += sorted(dots + ([(*m.span("at"), "@")] if spoken else []))
    now = now.edit(edits)
    now = now.edit([(*m.span(), ".") for m in BRACKET_DOT.finditer(now.text)])
    return now.edit([(*m.span(), ".") for m in NUMBER_DOT.finditer(now.text)])


TRANSDUCERS = (look_alikes, spelled_digits, at_and_dot)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the text as the transducers write it, at their place in the source: those that meet no base span of their kind,
    and those that hold all they meet and more, as where a look-alike cuts off the start of a plain address."""
    if not HINT.search(text):
        return []
    now = Rewritten(text)
    for step in TRANSDUCERS:
        now = step(now)
    if now.text == text:
        return []
    plain: dict[int, list[tuple[int, int]]] = {k: [(s, e) for s, e, x in base if x == k] for k in range(len(KINDS))}
    out, ends = [], [0] * len(KINDS)
    for s, e, k in base_spans(now.text):
        a, b = now.source(s, e)
        # base spans of a kind don't overlap, so those that this one meets stand together
        first, last = bisect_right(plain[k], a, key=lambda x: x[1]), bisect_left(plain[k], b, key=lambda x: x[0])
        met = plain[k][first:last]
        holds = not met or (a <= met[0][0] and met[-1][1] <= b and (a, b) not in met)
        if holds and a >= ends[k]:
            ends[k] = b
            out.append((a, b, k))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans")}
        for text in strings(batch.column(1)):
            base = base_spans(text)
            more = added_spans(text, base)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[2] == k for x in base))
            out["n_added"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(base + more))
        yield {"doc_id": batch.column(0)} | out

    numbers = ", ".join(f"n_{k} long" for k in (*KINDS, "added"))
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {numbers}, base_sha256 string, spans string")


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans become one, named by the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            i = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(i).to_pylist():
                if text:
                    base = base_spans(text)
                    parts, at = [], 0
                    for s, e, k in sorted(base + added_spans(text, base), key=lambda x: (x[0], x[2])):
                        if s >= at:
                            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
