"""Replies of any shape, uploads of any kind, and quality reports per document."""

import hashlib
import json

from pyspark.sql import functions as F

from signalbook.operators import quality, uploads
from signalbook.sources.replies import parse_replies

FILES = "document_id string, filename string, content string, at int"


def read(spark, *bodies):
    rows = [(i, b if isinstance(b, str) or b is None else json.dumps(b), "Hello world") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id int, raw string, text string")
    return {r.id: r for r in parse_replies(df, "id", "raw", "text").collect()}


def test_replies_of_the_wrong_shape(spark):
    got = read(
        spark,
        {"fields": "none", "entities": {"type": "x"}, "sentiment": "neutral", "sentiment_score": "much"},
        {"fields": ["stray", None, 3, [], {"field": "a", "value": {"k": [1, 2]}, "confidence": "high", "text_span": 5}], "extra": {"deep": [1]}},
        {"fields": [{"confidence": "0.5", "value": None}], "topics": "alone"},
        [1, 2],
        "7",
        None,
        "",
    )
    assert [(f.field, f.value, f.confidence) for f in got[0].fields] == [("sentiment", "neutral", 0.7)] and got[0].entities == []
    assert [(f.field, f.value, f.confidence, f.char_start) for f in got[1].fields] == [("a", '{"k":[1,2]}', 0.7, -1)]
    assert [(f.field, f.value, f.confidence) for f in got[2].fields] == [("unknown", None, 0.5)]
    assert [got[i].parsed for i in range(7)] == [True, True, True, False, False, False, False]


def test_uploads(spark):
    rows = [
        ("d1", "a.TXT", "one", 5), ("d2", "b.txt", "one", 3), ("d3", "c.exe", "one", 1), ("d4", "noend", "x", 1), ("d5", "e.csv", "long text", 1),
        ("d6", "f.json", None, 1), ("d7", "g.json", "", 2), ("d8", None, "y", 1), ("d9", "h.txt", "old", 1), ("e1", "dir.txt/plain", "z", 1), ("e2", "tie.txt", "t", 7), ("e3", "tie.txt", "t", 7),
    ]
    files = spark.createDataFrame(rows, FILES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    known = spark.createDataFrame([(sha("old"), "before"), (sha("unused"), "k")], "file_hash string, document_id string")
    got = {r.document_id: r for r in uploads.intake(files, ["at"], max_bytes=5, known=known).collect()}
    assert len(got) == len(rows)
    assert {k: (r.status, r.stored_as) for k, r in got.items() if r.status != "refused"} == {
        "d1": ("duplicate", "d2"), "d2": ("uploaded", "d2"), "d6": ("uploaded", "d6"), "d7": ("duplicate", "d6"), "d9": ("duplicate", "before"),
        "e2": ("uploaded", "e2"), "e3": ("duplicate", "e2"),
    }
    assert {k: r.reason for k, r in got.items() if r.status == "refused"} == {
        "d3": "file type not allowed", "d4": "file type not allowed", "d5": "file too large", "d8": "file type not allowed", "e1": "file type not allowed",
    }
    assert got["d1"].file_type == "txt" and got["d1"].file_hash == sha("one") and got["d3"].file_hash is None and got["d6"].file_size_bytes == 0
    assert uploads.intake(files.limit(0), ["at"]).count() == 0
    assert uploads.stored_files(uploads.intake(files, ["at"])).count() == 5  # one, long text, the empty one, old, t


def test_report_per_document_equals_report_of_the_document(spark):
    rows = [(f"d{i % 3}", f"f{i % 3}", ["ticket", "customer_intelligence", None][i % 3], None if i % 4 == 0 else f"T{i % 5}", ["p1", "bad", ""][i % 2 + i % 3 // 2],
             "2024-01-09" if i % 7 else "2010-02-01", "2024-01-05" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "document_id string, dataset_name string, domain string, ticket_number string, priority string, created_date string, end_date string")
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    reports = {r.document_id: r for r in quality.document_reports(df, at).collect()}
    assert len(reports) == 3
    for i, kind in enumerate(["ticket", "customer", ""]):
        own = df.filter(F.col("document_id") == f"d{i}").drop("document_id", "dataset_name", "domain")
        want = quality.quality_report(own, f"f{i}", kind, at).first().asDict()
        got = reports[f"d{i}"].asDict()
        assert {k: got[k] for k in want} == want
    assert quality.document_reports(df.limit(0), at).count() == 0
