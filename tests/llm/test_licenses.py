"""License scan: places and spans by hand-made texts and a plain search."""

import re

import pytest
from pyspark.sql import functions as F

from signalbook.llm import licenses, queries

COLUMNS = "doc_id long, text string"
MIT = licenses.NOTICES[0].text


def scan(spark, texts, **settings):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, COLUMNS), **settings).collect()
    return {r["doc_id"]: (r["n_words"], [(s["start"], s["end"], s["label"], s["exact"], s["score"]) for s in r["spans"]]) for r in got}


def test_phrases_are_found_wherever_they_stand(spark):
    got = scan(
        spark,
        [
            "Released UNDER the MIT-License.",
            "cc by-nc, cc (by) nc; cc by nc",
            "under the MIT\n\nlicense and the Apache License, Version 2.0",
            "under the mit licensé",
            "cc by ncx, xcc by nc",
            "",
            None,
            "\t \n",
            "cc by",
        ],
    )
    assert got[0] == (5, [(1, 5, "mit", True, 1.0)])
    assert [s[:3] for s in got[1][1]] == [(0, 3, "cc-by-nc"), (3, 6, "cc-by-nc"), (6, 9, "cc-by-nc")]
    assert [s[:3] for s in got[2][1]] == [(0, 4, "mit"), (6, 10, "apache-2")]
    assert [got[i] for i in range(3, 9)] == [(4, []), (6, []), (0, []), (0, []), (0, []), (2, [])]


def test_notice_with_words_put_in_and_left_out(spark):
    held = MIT.split()
    edited = held[:20] + ["really"] + held[20:40] + held[41:]
    got = scan(spark, [" ".join(["intro"] * 7 + edited + ["end"]), " ".join(held[:30]), " ".join(reversed(held))])
    (span,) = got[0][1]
    assert span[:4] == (7, 7 + len(edited), "mit", False)
    assert 0.9 < span[4] < 1
    assert got[1][1] == [] and got[2][1] == []


def test_two_occurrences_are_two_spans(spark):
    got = scan(spark, [f"{MIT} and then {MIT}"])
    size = len(MIT.split())
    assert [s[:3] for s in got[0][1]] == [(0, size, "mit"), (size + 2, 2 * size + 2, "mit")]


def test_long_text_and_far_phrase(spark):
    got = scan(spark, ["word " * 200_000 + "under the mit license"])
    assert got[0] == (200_004, [(200_000, 200_004, "mit", True, 1.0)])


def test_words_by_the_pattern(spark):
    texts = ["Ünder_the [MIT] licénse", "a\x00b\x7fc", "x y z", "1.0-2"]
    got = scan(spark, texts)
    assert [got[i][0] for i in range(4)] == [len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())) for t in texts]


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc"), (1, "plain")], COLUMNS)
    for name in ("content", "gram", "at", "template", "label", "place", "spans", "n_words"):
        docs = docs.withColumn(name, F.lit("x"))
    got = licenses.scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["spans"])) for r in got) == [("1", 1, 0), ("1", 3, 1), ("1", 3, 1), ("None", 3, 1)]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], COLUMNS)).collect() == []


def test_own_templates(spark):
    own = (licenses.Template("own", "do what you like with it"),)
    assert [s[2] for s in scan(spark, ["you may Do what you like, with it!"], templates=own)[0][1]] == ["own"]
    with pytest.raises(ValueError):
        scan(spark, ["x"], templates=(licenses.Template("short", "two words"),))


def test_query_columns(spark, tmp_path):
    rows = [(1, f"cc by nc {MIT}"), (2, MIT), (3, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_license_scan(spark, str(tmp_path)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (1, 0, "cc-by-nc", "cc-by-nc,mit")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["base_labels"], got[2]["labels"], got[2]["score"]) == (0, None, "", "mit", 1.0)
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"]) == (0, "", 0.0)
