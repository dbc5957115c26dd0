"""Fill-in-the-middle: against plain string code, the index of multibyte characters, exact round trips."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalbook.llm import fill_middle as fim

COLUMNS = "doc_id long, text string"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXT = st.text(st.sampled_from("ab é😀ß　\t\n<PSM>"), max_size=40)


def plain(key, text, unit="word"):
    """(n, form, prefix_chars, middle_chars, output) by string operations."""
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text) if unit == "word" else list(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=12), st.sampled_from(["word", "char"]), st.booleans())
def test_batches_against_strings(texts, unit, wide):
    keys = [str(i) for i in range(len(texts))]
    column = pa.array(["skipped", *texts], pa.large_string() if wide else pa.string())[1:]
    n, form, pre, mid, out = fim.rearrange_batch(keys, column, unit=unit)
    got = [(int(a), b, c, d, e.decode()) for a, b, c, d, e in zip(n, form, pre, mid, out)]
    assert got == [plain(k, t, unit) for k, t in zip(keys, texts)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abé😀ß字"), max_size=60))
def test_index_converts_both_ways(text):
    index = fim.ExceptionIndex.of(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    at = np.array([len(text[:i].encode()) for i in points])
    assert (index.points(at) == points).all() and (index.bytes(points) == at).all()
    assert len(index.byte) == sum(len(c.encode()) > 1 for c in text)


CASES = ["", None, " ", "\n\t ", "one", " lead", "trail ", "é" * 70_000 + " 😀", "word " * 100_000, "has <P> mark", "a<b <S", "　x y", "<M"]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_whole_operator_and_round_trip(spark, unit):
    rows = [(i, t) for i, t in enumerate(CASES * 6)] + [(5, "again and again")] * 2 + [(None, "no id at all")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in ("key", "n", "form", "output"):
        docs = docs.withColumn(name, F.lit("x"))
    made = fim.rearrange(docs, unit=unit)
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    want = [(i, *plain("null" if i is None else i, t or "", unit)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = made.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in rows)


def test_empty_table_and_text_ids(spark):
    assert fim.rearrange(spark.createDataFrame([], COLUMNS)).collect() == []
    got = fim.rearrange(spark.createDataFrame([("x", "some words here")], "doc_id string, text string")).collect()
    assert tuple(got[0])[1:] == plain("x", "some words here")
    with pytest.raises(ValueError):
        fim.rearrange(spark.createDataFrame([], COLUMNS), unit="line")
