"""Nulls, long lists, empty tables and look-alike keys lose nothing."""

import datetime as dt

from pyspark.sql import functions as F

from signalbook.functions import extract as ex
from signalbook.functions import lexicon
from signalbook.functions.values import stable_id
from signalbook.operators import profile, quality, resolve, serving, series, staging
from signalbook.operators.positions import number_rows
from signalbook.sources import files
from signalbook.streaming import jobs


def test_rows_with_null_keys_and_chunks_are_numbered(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 2), (None, 1)], "k string, n int")
    got = {(r.k, r.n): r.row_number for r in number_rows(rows, ["k"], ["n"], F.col("n")).collect()}
    assert got == {("a", None): 1, ("a", 1): 2, (None, 1): 1, (None, 2): 2}


def test_series_without_a_key_are_watched(spark):
    values = [1.0] * 20 + [1.5, 0.5, 90.0]
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(None, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "k string, t timestamp_ntz, value double")
    assert [r.value for r in series.zscore_anomalies(rows, ["k"]).collect()] == [90.0]
    assert {r.value for r in series.iqr_anomalies(rows, ["k"]).collect()} == {90.0, 1.5, 0.5}
    assert series.trend(rows, ["k"], F.to_date("t")).count() == 1
    assert series.rolling_anomalies(rows, ["k"], F.to_date("t"), width=5).filter("value = 90").count() == 1


def test_document_without_text_has_a_page(spark):
    pages = profile.text_pages(spark.createDataFrame([(1, None), (2, "a\nb")], "id int, text string"), "id").collect()
    assert {(p.id, p.line_count, p.word_count, p.page_text) for p in pages} == {(1, 1, 0, ""), (2, 2, 2, "a\nb")}


def test_empty_table_has_a_profile(spark):
    rows = profile.column_profile(spark.createDataFrame([], "a int, b string"), ["a"]).collect()
    assert {(r.column_name, r.non_null_count, r.null_pct, r.unique_count, tuple(r.sample_values)) for r in rows} == {
        ("a", 0, None, 0, ()),
        ("b", 0, None, 0, ()),
    }


def test_deep_pages_reach_rows_without_a_sort_value(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, None)], "id int, at int")
    seen, last = [], (99, 0)
    while page := serving.page_after(rows, "at", "id", last, 1).collect():
        seen.append(page[0].id)
        last = (page[0].at, page[0].id)
    assert seen == [3, 1, 2, 4]


def test_ids_tell_keys_apart(spark):
    keys = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a", "b|", ""), ("a", "b", "")], "x string, y string, z string")
    ids = [r[0] for r in keys.select(stable_id(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert len(set(ids)) == len(ids)
    made = spark.range(20000).select(
        F.col("id").cast("string").alias("document_id"),
        resolve.new_canonical_id(F.lit("customer"), F.col("id").cast("string"), F.lit("")).alias("entity"),
    )
    numbers = made.select("entity", staging._auto_number("TK-").alias("number"))
    assert numbers.select("number").distinct().count() == numbers.select("entity").distinct().count() == 20000
    assert numbers.filter((F.length("number") != 35) | (F.length("entity") < 33)).count() == 0


def test_all_hits_of_a_text_are_kept(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 10)]
    text = " and ".join(days) + " cost " + ", ".join(f"${n}.00" for n in range(10, 19)) + ". " + ". ".join(f"Big Thing{chr(97 + i)}x" for i in range(12))
    row = spark.createDataFrame([(text,)], "text string").select(
        ex.dates(F.col("text")).alias("d"), ex.money(F.col("text"), strict=True).alias("m"), ex.key_phrases(F.col("text")).alias("p"),
        ex.dates(F.col("text"), keep=2).alias("d2"),
        lexicon.topics(F.lit("a b c d e f g"), {c: [c] for c in "abcdefg"}).alias("t"),
    ).first()
    assert set(days) <= set(row.d) and len(row.d2) == 2 and len(row.t) == 7
    assert len(row.m) >= 9 and len(row.p) >= 10


def test_issue_values_are_whole(spark):
    bad = "x" * 80 + "@"
    rows = spark.createDataFrame([("1", "T1", bad), ("2", "T1", bad)], "row_id string, ticket_number string, customer_email string")
    issues = quality.quality_issues(rows, "ticket", "row_id").filter("kind = 'invalid_value' and field = 'customer_email'").collect()
    assert {i.value for i in issues} == {bad}


def test_csv_files_are_split_and_uploads_follow_the_readers(spark, tmp_path):
    folder = str(tmp_path / "csv")
    files.write_csv(spark.range(1000).select("id", F.lit("a b").alias("t")).coalesce(1), folder)
    assert files.read_csv(spark, folder).count() == 1000
    (tmp_path / "in").mkdir()
    for name in ("a.log", "b.md", "c.pdf", "d.JSON"):
        (tmp_path / "in" / name).write_text("x")
    accepted, refused = files.read_uploads(spark, str(tmp_path / "in"))
    assert {r.file_type for r in accepted.select("file_type").collect()} == {"log", "md", "json"}
    assert [r.reason for r in refused.collect()] == ["file type not allowed"]
    (tmp_path / "rows.json").write_text('{"a": 1, "b": "x"}\n')
    assert files.read_json(spark, str(tmp_path / "rows.json"), "a int, b string").first() == (1, "x")


def test_late_copies_meet_what_is_stored(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, (text, day) in enumerate([("a", 0), ("b", 10), ("c", 20), ("a", 30)]):  # the copy of a is far behind the watermark
        spark.createDataFrame([(i, text, start + dt.timedelta(days=day))], "doc_id int, text string, at timestamp").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = jobs.distinct_content(jobs.read_new_files(spark, source, schema, files_per_batch=1), "text", "at", "1 day")
    jobs.load_new(stream, target, state, "content_hash", lambda batch: batch).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(target).select("text").collect()) == ["a", "b", "c"]


def test_replies_become_facts(spark):
    reply = """{"fields": [{"field": "ticket_number", "value": "TK-77", "confidence": 0.9, "text_span": "TK-77"},
        {"field": "severity", "value": "Sev1", "confidence": 0.6}, {"field": "issue_description", "value": "login  error", "confidence": 0.4}],
        "entities": [{"type": "date", "value": "x"}, {"type": "company", "value": "Acme"}],
        "sentiment": "negative", "sentiment_score": 0.2, "topics": ["a", "b"], "key_phrases": ["k"], "summary": "s"}"""
    rows = [("D1", "customer_intelligence", "text with TK-77 in it", f"```json\n{reply}\n```"), ("D2", "customer_intelligence", "Ticket TK-1234567: outage", "no reply")]
    docs = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1)) for r in rows], "document_id string, domain string, text string, raw string, arrived_at timestamp")
    found = staging.extract_replies(docs)
    assert found.columns == staging.extract(docs.drop("raw")).columns
    by_id = {r.document_id: r for r in found.collect()}
    one = by_id["D1"]
    assert (one.customer_name, one.sentiment, one.topics, one.key_phrases, one.summary) == ("Acme", "negative", ["a", "b"], ["k"], "s")
    assert (one.fields[0].char_start, one.fields[0].char_end) == (10, 15)
    facts = {r.document_id: r for r in staging.ticket_facts(found.withColumn("customer_code", F.lit(None).cast("string"))).collect()}
    assert facts["D1"].ticket_number == "TK-77" and facts["D1"].title == "login error" and facts["D1"].tags == ["a", "b"]
    assert set(facts) == {"D1", "D2"}
    weak = staging.low_confidence_items(found).filter("document_id = 'D1'").collect()
    assert {(r.title, r.priority) for r in weak} >= {("Low-confidence extraction: issue_description", "high"), ("Low-confidence extraction: severity", "medium")}
    assert staging.extract_replies(docs, fallback=False).count() == 2
