"""Fill-in-the-middle: a text cut in three and put together with the middle last.

Cuts are drawn in units (words with the blanks before them, or code points) and made in the UTF-8
bytes of a whole Arrow batch.  Code points and bytes are converted by a sparse index: it records only
the characters of more than one byte, where they begin and how many bytes they have in excess.  A
binary search among them gives the excess before a cut; between them the two counts run in step, so
a text in ASCII has no entries and its positions are plain arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.llm.common import by_value, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentage of the texts that are rearranged, and of these that have the suffix first.
RATE = 50
SUFFIX_FIRST = 80
SEED = 42
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class ExceptionIndex(NamedTuple):
    """Multibyte characters of a buffer: first byte and code point of each, and the excess before it.

    ``excess`` has one more entry, the excess of all.
    """

    byte: np.ndarray
    point: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> ExceptionIndex:
        byte = np.flatnonzero(data >= 0xC0)
        lead = data[byte]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(more)])
        return cls(byte, byte - excess[:-1], excess)

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before the given bytes (each the first of a character, or the end)."""
        return at - self.excess[np.searchsorted(self.byte, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before the given code points."""
        return at + self.excess[np.searchsorted(self.point, at)]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after the other, and the bounds of each; no text is null."""
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Units(NamedTuple):
    """Where the units of every text end: text i has ``count[i]`` of them."""

    count: np.ndarray
    ends: np.ndarray  # last byte + 1 of each word, of all texts
    first: np.ndarray  # of the text's words in ``ends``
    words: np.ndarray

    def cut(self, units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The byte after so many units of each text."""
        inside = np.clip(self.first + units - 1, 0, max(len(self.ends) - 1, 0))
        at = self.ends[inside] if len(self.ends) else start
        return np.where(units == 0, start, np.where(units > self.words, end, at))


def word_units(data: np.ndarray, bounds: np.ndarray) -> Units:
    """Words with the blanks before them; blanks after the last word are one more unit."""
    blank = BLANKS[data]
    after = np.concatenate([blank[1:], [True]])
    ends_here = bounds[1:][bounds[1:] > 0]
    after[ends_here - 1] = True
    ends = np.flatnonzero(~blank & after) + 1
    first = np.searchsorted(ends, bounds[:-1], "right")
    words = np.searchsorted(ends, bounds[1:], "right") - first
    filled = bounds[1:] > bounds[:-1]
    trailing = np.zeros(len(filled), bool)
    trailing[filled] = blank[bounds[1:][filled] - 1]
    return Units(words + trailing, ends, first, words)


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the key of a row."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearrange_batch(
    keys: list[str], texts: pa.Array, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "word"
) -> tuple[np.ndarray, list[str], list, list, list[bytes]]:
    """n, form, prefix_chars, middle_chars and the output bytes of each text."""
    data, bounds = buffers(texts)
    start, end = bounds[:-1], bounds[1:]
    index = ExceptionIndex.of(data)
    base = index.points(bounds)
    drawn = np.array([draws(key, seed) for key in keys], np.int64).reshape(len(keys), 4)
    units = word_units(data, bounds) if unit == "word" else None
    n = units.count if unit == "word" else np.diff(base)
    low, high = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1).T
    if unit == "word":
        cuts = np.stack([units.cut(low, start, end), units.cut(high, start, end)])
        points = index.points(cuts.ravel()).reshape(2, -1)
    else:
        points = np.stack([low, high]) + base[:-1]
        cuts = index.bytes(points.ravel()).reshape(2, -1)
    whole = data.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    form, prefix_chars, middle_chars, output = [], [], [], []
    for i in range(len(keys)):
        text = whole[start[i] : end[i]]
        if not text or drawn[i, 2] % 100 >= rate or any(mark in text for mark in marks):
            form.append("plain")
            prefix_chars.append(None)
            middle_chars.append(None)
            output.append(text)
            continue
        a, b = cuts[0, i] - start[i], cuts[1, i] - start[i]
        pre, mid, suf = text[:a], text[a:b], text[b:]
        spm = drawn[i, 3] % 100 < suffix_first
        form.append("spm" if spm else "psm")
        prefix_chars.append(int(points[0, i] - base[i]))
        middle_chars.append(int(points[1, i] - points[0, i]))
        p, s, m = marks
        output.append(b"".join((s, suf, p, pre, m, mid) if spm else (p, pre, s, suf, m, mid)))
    return n, form, prefix_chars, middle_chars, output


def rearrange(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    unit: str = "word",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row per row of ``docs``.

    ``unit`` is what is counted and never cut: "word" (with the blanks before it; blanks at the end
    are one more) or "char".  Both cuts are drawn from a hash of seed and id, so repeated rows get the
    same result and a null id counts as the id "null".  An empty or null text, a text that holds a
    marker, and all but ``rate`` per cent stay plain, without counts of characters.  Texts are cut
    whole; other columns are ignored; an empty table gives no rows.
    """
    if unit not in ("word", "char"):
        raise ValueError(f"unit is word or char, not {unit}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            n, form, prefix_chars, middle_chars, output = rearrange_batch(keys, batch.column("text"), seed, rate, suffix_first, unit)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(prefix_chars, pa.int64()),
                "middle_chars": pa.array(middle_chars, pa.int64()),
                "output": pa.array(output, pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("key"),
        text_of(F.col(f"`{text_col}`")).alias("text"),
    )
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged.  A rearranged text holds each marker once, so they part it."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


by_value(__name__)
