"""Merkle manifest: digests and proofs against a plain recursion, and what happens at the edges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from signalbook.llm import merkle, queries
from signalbook.session import scratch_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(digests, fanout=8):
    """All levels from the leaves to the one node left."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, place, fanout=8):
    out = []
    for level in levels[:-1]:
        first = place // fanout * fanout
        run = level[first : first + fanout]
        out += [run[: place - first], run[place - first + 1 :]]
        place //= fanout
    return [d for part in out for d in part]


def expected(rows):
    """(doc_id, leaf, subroot, root, proof) of every row, by plain lists."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*map(enc, (doc_id, source, lang, n_chars, text)))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf for _, _, leaf, _ in sorted(groups[g])]) for g in names}
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for tree, g in enumerate(names):
        for place, (_, _, leaf, doc_id) in enumerate(sorted(groups[g])):
            proof = siblings(trees[g], place) + siblings(top, tree)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(*proof)))
    return sorted(out, key=repr)


def proven(spark, rows, **settings):
    docs = spark.createDataFrame(rows, COLUMNS)
    manifest = merkle.build(docs, **settings)
    got = merkle.prove(manifest, manifest.leaves.select("tree", "rank", "id"))
    got = got.select("id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256), merkle.fold(F.col("leaf"), F.col("proof")))
    return got.collect()


CASES = {
    "one row": [(1, "a", "en", "s", 1)],
    "runs of eight and a run of one": [(i, f"text {i}", "en", "s", 6) for i in range(65)] + [(i, "x", "de", None, 1) for i in range(100, 109)],
    "many groups": [(i, "x", f"lang{i % 70}", "s", 1) for i in range(150)],
    "nulls, empty, long, not ascii": [
        (None, None, None, None, None),
        (None, "", "", "", 0),
        (3, "é😀" * 50_000, "é", "s", 100_000),
        (2, "word " * 100_000, None, "s", None),
    ],
    "repeated rows and ties": [(7, "same", "en", "s", 4)] * 20 + [(7, f"other {i}", "en", "s", 4) for i in range(5)],
}


@pytest.mark.parametrize("case", CASES)
def test_proofs_against_plain_lists(spark, case):
    rows = CASES[case]
    got = proven(spark, rows)
    assert sorted([tuple(row[:5]) for row in got], key=repr) == expected(rows)
    assert all(row[5] == row[3] for row in got)


def test_empty_table(spark):
    assert proven(spark, []) == []
    assert merkle.build(spark.createDataFrame([], COLUMNS)).root.count() == 0


def test_other_fanout_and_clashing_columns(spark):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(10)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in ("tree", "rank", "digest", "path", "group", "id", "_at_spot"):
        docs = docs.withColumn(name, F.lit(1))
    manifest = merkle.build(docs, fanout=3)
    assert [r["root"] for r in manifest.root.collect()] == [climb([r["digest"] for r in manifest.leaves.orderBy("rank").collect()], 3)[-1][0]]


def test_some_requests_and_reopened_manifest(spark):
    rows = CASES["runs of eight and a run of one"]
    path = scratch_path(spark, "manifest")
    built = merkle.build(spark.createDataFrame(rows, COLUMNS), path=path)
    again = merkle.open_manifest(spark, path)
    asked = again.leaves.where("id IN (3, 64, 108)").select("tree", "rank", "id")
    got = merkle.prove(again, asked).select("id", merkle.fold(F.col("leaf"), F.col("proof")).alias("folded"), "root").collect()
    assert sorted(r["id"] for r in got) == [3, 64, 108]
    assert all(r["folded"] == r["root"] == built.root.first()["root"] for r in got)
    beyond = spark.createDataFrame([(0, 9), (5, 0)], "tree long, rank long")
    assert merkle.prove(again, beyond).count() == 0


def test_records_are_content_addressed(spark):
    # Two groups with the same leaves share every inner node.
    rows = [(i, "x", g, "s", 1) for g in ("a", "b") for i in range(70)]
    manifest = merkle.build(spark.createDataFrame(rows, COLUMNS), fields=("doc_id", "text"))
    kept = merkle.records(manifest).collect()
    assert all(h(*r["children"]) == r["digest"] for r in kept)
    assert len(kept) == len({r["digest"] for r in kept}) == 9 + 2 + 1 + 1


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(40)] + [(40, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    for row in queries.op11_merkle_manifest(spark, str(tmp_path)).collect():
        i = row["doc_id"]
        spoilt = zlib.crc32(str(i).encode()) % 3 == 0 and i % 2 == 1
        assert row["verified"] == (not spoilt) == (row["folded_root"] == row["root"])
