"""The analyser of the keyword path: one function from texts to terms, for chunks and requests alike."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: identifiers, which stay whole, and what a term must hold.
IDENTIFIER = re.compile(r"[0-9A-Za-z]+(?:[._\-+#&]+[0-9A-Za-z]+)*")
RETAINED = re.compile(r"[^\W_]")
WORD = re.compile(r"[^\W_]+")
#: What words() leaves of a whole text: between identifiers no letter or digit of ASCII is left.
PLAIN = re.compile(IDENTIFIER.pattern + r"|[^\W_\x00-\x7f]+")
#: Texts whose terms are in Python at once.
AT_ONCE = 256
Segmenter = Callable[[str], Iterable[str]]


def normalise(text: str) -> str:
    """Compatibility forms and case are folded, so that what looks alike is alike."""
    return unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[str]:
    """The segmenter of the queries: runs of letters and digits."""
    return WORD.findall(text)


def tokenize(text: str, segment: Segmenter = words) -> list[str]:
    """Terms in order, repeated ones too: identifiers, and what the segmenter makes of the text between them; pieces without a
    letter or digit are dropped."""
    folded = text.casefold() if text.isascii() else normalise(text)
    if segment is words:
        return PLAIN.findall(folded)
    terms, at = [], 0
    for found in IDENTIFIER.finditer(folded):
        if found.start() > at:
            terms += [t for raw in segment(folded[at : found.start()]) if RETAINED.search(t := raw.strip())]
        terms.append(found.group())
        at = found.end()
    return terms + [t for raw in segment(folded[at:]) if RETAINED.search(t := raw.strip())]


def listed(texts: pa.Array, segment: Segmenter = words) -> pa.Array:
    """The terms of each text. Only AT_ONCE texts' terms are Python strings at a time, however large the batch."""
    kind = pa.list_(pa.string())
    parts = [pa.array([tokenize(t, segment) if t else [] for t in texts.slice(k, AT_ONCE).to_pylist()], kind) for k in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def terms(column: Column | str, segment: Segmenter = words) -> Column:
    """The terms of a text column as an array, in Arrow batches; null texts have none. segment must be a function that can be
    sent to workers, such as one that loads its dictionary when first called there."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return listed(texts, segment)

    return run(column)
