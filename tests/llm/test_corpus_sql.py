"""Corpus queries against their SQL, and against brute force where SQL has no words for them."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

from signalbook.llm import queries, secrets
from tests.compare import difference, duck, rows_of_duck, rows_of_spark

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def documents(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def result(spark, name):
    return {row["doc_id"]: row for row in queries.QUERIES[name](spark, FOLDER).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, con, name):
    got = rows_of_spark(queries.QUERIES[name](spark, FOLDER))
    assert not difference(got, rows_of_duck(con, queries.ORACLE[name]))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_simhash_against_all_pairs(spark, documents):
    got = result(spark, "op8_simhash")
    fp = {}
    for doc_id, text in documents.items():
        words = WORD.findall(lowered(text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        fp[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {k: row["fingerprint"] for k, row in got.items()} == {k: f"{v:016x}" for k, v in fp.items()}
    ids = sorted(fp)
    value = np.array([fp[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(value ^ value[i]) <= 4):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    assert {k: row["component_id"] for k, row in got.items()} == {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_secrets_against_plain_patterns(spark, documents):
    got = result(spark, "op10_secrets")
    patterns = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
    }
    for doc_id, text in documents.items():
        spans = []
        for place, (kind, (pattern, group, least)) in enumerate(patterns.items()):
            found = [m for m in pattern.finditer(text) if len(m[group]) >= least]
            assert got[doc_id][f"n_{kind}"] == len(found)
            spans += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in found]
        base = ",".join(s for _, _, s in sorted(spans))
        assert got[doc_id]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        kept = [s for s in got[doc_id]["spans"].split(",") if s.split(":")[0] in patterns]
        assert ",".join(kept) == base


def test_fingerprints_against_true_similarity(spark, documents):
    got = result(spark, "op6_fingerprints")
    ids = sorted(documents)
    off = []
    for doc_id, after in zip(ids, ids[1:] + ids[:1]):
        text, other = documents[doc_id], documents[after]
        n = len(text)
        edited = text[: n - n // 2] + other[: n // 2]
        row = got[doc_id]
        assert row["n_chars"] == n
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, b in (("near_edited", edited), ("near_next", other)):
            off.append(row[column] - true_similarity(text, b))
        if text == edited:
            assert row["fingerprint"] == row["edited_fingerprint"]
    # 64 samples: a standard deviation of at most 1 / 16, and no bias over all documents
    assert abs(np.mean(off)) < 0.01
    assert np.sqrt(np.mean(np.square(off))) < 0.065
    by_text = {}
    for doc_id, text in documents.items():
        assert by_text.setdefault(text, got[doc_id]["fingerprint"]) == got[doc_id]["fingerprint"]


def true_similarity(a, b):
    count = lambda text: dict(zip(*np.unique(WORD.findall(text), return_counts=True)))
    one, two = count(a), count(b)
    terms = set(one) | set(two)
    if not terms:
        return 1.0
    return sum(min(one.get(t, 0), two.get(t, 0)) for t in terms) / sum(max(one.get(t, 0), two.get(t, 0)) for t in terms)


def test_quality_on_held_out_documents(spark, con, documents):
    got = result(spark, "op4_quality")
    assert set(got) == set(documents)
    label = dict(con.execute("SELECT doc_id, max(quality) FROM labels GROUP BY doc_id").fetchall())
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    right = [got[i]["predicted"] == label[i] for i in held if i in label]
    assert np.mean(right) >= 0.9
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.3) for row in got.values())


def test_pieces_are_lossless(spark, documents):
    got = result(spark, "op2_sentencepiece")
    assert set(got) == set(documents)
    assert all(row["lossless"] and row["n_chars"] == len(documents[i]) for i, row in got.items())


def test_page_text_keeps_visible_words(spark, con):
    got = {row["page_id"]: row["text"] for row in queries.QUERIES["op7_html_text"](spark, FOLDER).collect()}
    import html

    for page_id, page in con.execute("SELECT page_id, html FROM pages").fetchall():
        body = re.sub(r"(?s)<head>.*?</head>|<(script|style|template|noscript)\b.*?</\1>|<!--.*?-->", " ", page)
        plain = html.unescape(re.sub(r"<[^<>]*>", " ", body))
        assert sorted("".join(plain.split())) == sorted("".join(re.sub(r"(?m)^\s*(?:-|\d+\.) |\s\|\s", " ", got[page_id]).split())) or set(
            WORD.findall(plain)
        ) - set(WORD.findall(got[page_id])) == set(), page_id


def test_rules_are_kept_apart():
    assert [rule.kind for rule in secrets.BASE_RULES] == ["assign", "access", "hex"]
