"""Quality, profiles, sources, lists and updates on hand-made rows."""

from pyspark.sql import functions as F

from signalbook.functions.values import instant
from signalbook.operators import profile, quality, serving
from signalbook.operators.positions import number_rows
from signalbook.sources import files
from signalbook.sources.replies import parse_replies

COLUMNS = "ticket_number string, customer_name string, priority string, status string, created_date string, resolved_date string, customer_email string"
DIRTY = [
    ("T1", "Ann", "high", "open", "2024-01-05", "2024-01-01", "a@b.org"),
    ("T1", "Ann", "high", "open", "2024-01-05T10:00:00", "2024-01-06", "broken"),
    ("T2", None, "x", "open", "05/01/2024", None, ""),
    ("T2", "x", "", "", "2020-01-01", "2020-01-02", None),
    ("", "", None, None, None, None, None),
]


def test_quality_report(spark):
    df = spark.createDataFrame(DIRTY, COLUMNS)
    r = quality.quality_report(df, "t", "ticket", instant("2024-02-01 00:00:00")).first()
    # keys: T1|Ann|high twice, T2|x twice (a blank is left out), the empty key does not count
    assert (r.total_records, r.duplicate_records, r.missing_critical_fields) == (5, 2, 8)
    # bad: one date, two e-mails, two priorities
    assert (r.invalid_records, r.records_requiring_review) == (3, 5)
    assert (r.completeness_score, r.validity_score, r.uniqueness_score) == (68.0, 85.7, 60.0)
    # only the first row starts after its end; only the fourth is older than two years
    assert (r.consistency_score, r.timeliness_score) == (80.0, 80.0)
    assert r.overall_score == 73.8


def test_empty_table_scores_zero(spark):
    r = quality.quality_report(spark.createDataFrame([], COLUMNS), "t", "ticket", instant("2024-02-01")).first()
    assert (r.overall_score, r.completeness_score, r.total_records) == (0.0, 0.0, 0)


def test_issues(spark):
    df = spark.createDataFrame([(str(i), *row) for i, row in enumerate(DIRTY)], "row_id string, " + COLUMNS)
    kinds = {r.kind: r["count"] for r in quality.quality_issues(df, "ticket", "row_id").groupBy("kind").count().collect()}
    assert kinds == {"missing_critical_field": 5, "invalid_value": 5, "duplicate_record": 2, "date_ordering": 1}
    assert quality.quality_issues(df, "ticket", "row_id", keep=3).count() == 3


def test_positions_in_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), ((F.col("id") * 17) % 3000).alias("v"))
    got = number_rows(rows, ["k"], ["v"], F.floor(F.col("v") / 100)).collect()
    for k in ("hot", "cold"):
        ordered = sorted((r for r in got if r.k == k), key=lambda r: r.v)
        assert [r.row_number for r in ordered] == list(range(1, len(ordered) + 1))


def test_pages_of_text(spark):
    text = "\n".join(f"line {i}" for i in range(7))
    got = profile.text_pages(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), "id", lines_per_page=3).orderBy("id", "page_number").collect()
    assert [r.page_text for r in got] == ["line 0\nline 1\nline 2", "line 3\nline 4\nline 5", "line 6", ""]
    assert (got[0].line_count, got[0].word_count, got[0].total_pages, got[3].word_count) == (7, 14, 3, 0)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('id,name,note\n1,Ann,NA\n2,"B, ""C""",\n3,null,x\n')
    (tmp_path / "in" / "b.txt").write_text("one\ntwo")
    (tmp_path / "in" / "c.exe").write_text("x")
    scanned = files.read_by_format(spark, str(tmp_path / "in" / "a.csv"), ".CSV")
    assert [tuple(r) for r in scanned.orderBy("id").collect()] == [("1", "Ann", None), ("2", 'B, "C"', None), ("3", None, "x")]
    assert files.read_by_format(spark, str(tmp_path / "in" / "b.txt"), "txt").first().text == "one\ntwo"
    files.write_csv(scanned, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, scanned.collect()))
    ok, refused = files.read_uploads(spark, str(tmp_path / "in"), max_bytes=20)
    assert [r.file_type for r in ok.collect()] == ["txt"]
    assert sorted(r.reason for r in refused.collect()) == ["file too large", "file type not allowed"]


def test_replies(spark):
    body = '{"fields": [{"field": "a", "value": 3, "confidence": 0.9, "text_span": "Hello"}, {"value": "v", "text_span": "zzz"}], "entities": [{"type": "t"}], "sentiment": "positive"}'
    rows = [(1, body), (2, f"```json\n{body}\n```"), (3, f"Sure: {body} ok"), (4, "{broken"), (5, "{}")]
    df = spark.createDataFrame([(i, raw, "Hello world") for i, raw in rows], "id int, raw string, text string")
    got = {r.id: r for r in parse_replies(df, "id", "raw", "text").collect()}
    for i in (1, 2, 3):
        f = got[i].fields
        assert [(x.field, x.value, x.confidence, x.char_start, x.char_end) for x in f] == [
            ("a", "3", 0.9, 0, 5), ("unknown", "v", 0.7, -1, None), ("sentiment", "positive", 0.7, None, None)]
        assert got[i].overall_confidence == 0.77 and got[i].entities[0].value == ""
    assert not got[4].parsed and got[4].fields == [] and got[4].overall_confidence == 0.7
    assert got[5].parsed and got[5].fields == []


def test_extract_goldens(spark):
    levels = ["LOW"] * 4 + ["MEDIUM"] * 3 + ["HIGH"] * 2 + ["CRITICAL"]
    customers = spark.createDataFrame([(i, level) for i, level in enumerate(levels)], "customer_id int, risk_level string")
    assert [tuple(r) for r in serving.customers_by_risk(customers).collect()] == [("LOW", 4), ("MEDIUM", 3), ("HIGH", 2), ("CRITICAL", 1)]
    incidents = spark.createDataFrame([("1", "P1", True), ("2", "P1", True), ("3", "P2", True), ("4", "P2", False), ("5", "P3", False)], "incident_id string, severity string, sla_breached boolean")
    assert [tuple(r) for r in serving.breach_matrix(incidents).collect()] == [("P1", 2, 0), ("P2", 1, 1), ("P3", 0, 1)]


def test_paging(spark):
    df = spark.range(45).withColumn("g", F.col("id") % 2)
    rows = serving.page(serving.where_equal(df, g=0, id=None), [F.desc("id")], number=2, size=10).collect()
    assert [r.id for r in rows] == list(range(24, 4, -2)) and rows[0].total == 23
    after = serving.page_after(df.withColumn("o", F.floor(F.col("id") / 10)), "o", "id", (2, 25), size=6).collect()
    assert [r.id for r in after] == [26, 27, 28, 29, 10, 11]
    names = spark.createDataFrame([("a%b",), ("A_b",), ("axb",)], "name string")
    assert serving.name_contains(names, "a_b").count() == 3
    assert serving.name_contains(names, "a_b", literal=True).count() == 1


def test_review_actions(spark):
    items = spark.createDataFrame([("1", "pending"), ("2", "pending"), ("3", "pending")], "item_id string, status string")
    actions = spark.createDataFrame(
        [("1", "approved", 1, "ann", None, None), ("1", "edited", 2, "bob", "n", "v"), ("2", "nonsense", 3, "ann", None, None), ("9", "approved", 1, "ann", None, None)],
        "item_id string, action string, acted_at int, reviewer string, note string, edited_value string")
    got = {r.item_id: r for r in serving.apply_review_actions(items, actions).collect()}
    assert (got["1"].status, got["1"].edited_value, got["2"].status, got["3"].status) == ("edited", "v", "pending", "pending")
    _, refused = serving.split_actions(actions, items)
    assert {(r.item_id, r.reason) for r in refused.collect()} == {("2", "invalid action"), ("9", "review item not found")}
