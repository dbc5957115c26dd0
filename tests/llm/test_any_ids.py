"""Conversations and documents whose ids are texts, one of them the word null."""

import hashlib

from signalbook.llm import dialogue, fingerprints


def test_text_ids(spark):
    rows = [("null", "1", "ann", "hi"), ("null", "2", "bob", "yo"), (None, "1", "cy", "hm"), ("x-1", "two", "ann", "late"), ("x-1", "1", "bob", "soon")]
    turns = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")
    segments = dialogue.rotate(turns)
    assert dict(segments.dtypes)["conv_id"] == "string"
    got = {(r["conv_id"], r["perspective"]): (r["text"], len(r["masks"])) for r in dialogue.assembled(segments).collect()}
    assert set(got) == {("null", "ann"), ("null", "bob"), (None, "cy"), ("x-1", "ann"), ("x-1", "bob")}
    assert got["null", "bob"] == ("<|user:ann|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n", 1)
    assert got[None, "cy"] == ("<|assistant|>\nhm<|end|>\n", 1)
    assert got["x-1", "ann"][0].startswith("<|user:bob|>\nsoon")


def test_number_ids_become_long(spark):
    turns = spark.createDataFrame([(1, 0, "a", "x")], "conv_id int, turn int, role string, text string")
    assert dict(dialogue.rotate(turns).dtypes)["conv_id"] == "bigint"


def test_fingerprints_of_text_ids(spark):
    texts = ["one two three four", "five six seven", None, "one two three four", ""]
    ids = ["b-10", "a", "c", None, "0"]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id string, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs, samples=8).collect()}
    assert set(got) == set(ids) and dict(fingerprints.edited_fingerprints(docs, samples=8).dtypes)["doc_id"] == "string"
    order = [None, "0", "a", "b-10", "c"]
    text_of = dict(zip(ids, texts))
    for at, id_ in enumerate(order):
        text, after = (text_of[i] or "" for i in (id_, order[(at + 1) % len(order)]))
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[id_]["n_chars"] == len(text)
        assert got[id_]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[None]["signature"] == got["b-10"]["signature"] and got["0"]["signature"] == got["c"]["signature"]
