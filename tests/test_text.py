"""Text functions on hand-made rows, every branch."""

import unicodedata

from pyspark.sql import functions as F

from signalbook.functions import extract as ex
from signalbook.functions import lexicon, text as tx


def one_column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("s"))).collect()]


def test_normalize_text(spark):
    given = ["a\t\t b", "x\r\ny\rz", "a\n\n\n\nb", None, "", "  é ﬁ  "]
    want = ["a b", "x\ny\nz", "a\n\nb", "", "", unicodedata.normalize("NFKD", "é ﬁ")]
    assert one_column(spark, given, tx.normalize_text) == want


def test_normalize_name(spark):
    given = ["Acme Corp.", "ACME, Inc", "Zürich & Söhne SA", "Ltd.", "Corporate Co-op", None]
    assert one_column(spark, given, tx.normalize_name) == ["acme", "acme", "zurich sohne", "", "corporate op", ""]


def test_normalize_date(spark):
    given = ["2024-03-04", "03/04/2024", "12/25/2024", "04-03-2024", "March 4, 2024", "mar 4, 2024", "4 March 2024", "4 Mar 2024", "2024/3/4", "soon", None]
    want = ["2024-03-04", "2024-04-03", "2024-12-25", "2024-03-04", "2024-03-04", "2024-03-04", "2024-03-04", "2024-03-04", "2024-03-04", None, None]
    assert one_column(spark, given, tx.normalize_date) == want


def test_normalize_currency(spark):
    given = ["$1,234.50", "£99", "€ 5", "₹10", "CAD $7", "1.2.3", "free", "12 usd"]
    got = [tuple(r) if r else None for r in one_column(spark, given, tx.normalize_currency)]
    assert got == [(1234.5, "USD"), (99.0, "GBP"), (5.0, "EUR"), (10.0, "INR"), (7.0, "CAD"), None, None, (12.0, "USD")]


def test_normalize_severity(spark):
    given = ["P1", " sev2 ", "Moderate", "trivial", "High", "odd", None]
    assert one_column(spark, given, tx.normalize_severity) == ["critical", "high", "medium", "low", "high", "medium", "medium"]


def test_expand_abbreviations(spark):
    assert one_column(spark, ["the Db mgr", "vpnx vpn"], tx.expand_abbreviations) == ["the database manager", "vpnx VPN"]


def test_sentiment_branches(spark):
    given = ["nothing here", "great", "terrible", "good but slow", "good fast happy error", None]
    got = [(r.label, r.confidence) for r in one_column(spark, given, lexicon.sentiment)]
    assert got == [("neutral", 0.5), ("positive", 0.95), ("negative", 0.95), ("neutral", 0.65), ("positive", 0.86), ("neutral", 0.5)]


def test_severity_first_level_wins(spark):
    given = ["minor outage", "major change", "normal", "p4 thing", "hello"]
    got = [(r.level, r.confidence) for r in one_column(spark, given, lexicon.severity)]
    assert got == [("critical", 0.82), ("high", 0.82), ("medium", 0.82), ("low", 0.82), ("medium", 0.55)]


def test_topics_in_order_and_the_first_five(spark):
    given = ["mail network hack lost data install refund slow login vpn", "crash", "hello"]
    first = ["vpn", "authentication", "performance", "billing", "onboarding"]
    got = one_column(spark, given, lambda text: lexicon.topics(text, keep=5))
    assert got == [first, ["availability"], []]
    assert one_column(spark, given, lexicon.topics)[0] == [*first, "data_loss", "security", "network", "email"]


def test_issue_class_ties_and_counts(spark):
    given = ["VPN down, unable to connect to VPN", "printer and laptop", "hello", "refund credit of an invoice"]
    got = [tuple(r) for r in one_column(spark, given, lexicon.issue_class)]
    assert got == [("NETWORK", "VPN", 0.95), ("HARDWARE", "PRINTER", 0.85), ("GENERAL", "OTHER", 0.4), ("BILLING", "REFUND", 0.85)]


def test_customer_name(spark):
    given = ["Customer: Acme, asks", "mail from Globex Ltd", "client: ab, by Initech.", "nobody"]
    assert one_column(spark, given, ex.customer_name) == ["Acme", "Globex", "Initech", None]


def test_dates_and_money(spark):
    text = ["On 2024-01-02 and 03/04/24, again 2024-01-02, Jan 5, 2024; paid $1,200.00 or EUR 5"]
    assert one_column(spark, text, ex.dates)[0] == ["24-01-02", "03/04/24", "2024-01-02", "Jan 5, 2024"]
    strict = one_column(spark, ["a, b $1,200.00 5 Big"], lambda c: ex.money(c, strict=True))[0]
    assert [m.strip() for m in strict] == ["$1,200.00", "5"]
    loose = one_column(spark, ["a, b"], ex.money)[0]
    assert [m.strip() for m in loose] == [","]


def test_numbers_in_text(spark):
    assert one_column(spark, ["ticket #AB-12 open", "none"], ex.ticket_number) == ["AB-12", None]
    assert one_column(spark, ["mail a.b+c@d-e.org now", "@"], ex.email) == ["a.b+c@d-e.org", None]
    assert one_column(spark, ["INC: INC-7", "x"], ex.incident_number) == ["INC-7", None]
    assert one_column(spark, ["2 hours of outage", "30 min down", "5 days"], ex.downtime_minutes) == [120, 30, None]
    assert one_column(spark, ["agreement CN/9-A", "x"], ex.contract_number) == ["CN/9-A", None]


def test_key_phrases_in_all_scripts(spark):
    got = one_column(spark, ["Red Team met Blue Team and Red Team", "éRed Team x"], ex.key_phrases)
    assert got == [["Red Team", "Blue Team"], []]


def test_summary(spark):
    long = "a\n" + "b" * 400
    got = one_column(spark, [long, " short\ntext "], ex.summary)
    assert got == ["a " + "b" * 298 + "...", "short text"]
