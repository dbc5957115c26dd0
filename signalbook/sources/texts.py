"""Operational texts, mentions and dirty records written from the order tables.

The given documents hold invented words, so the business word lists find nothing
in them.  These builders write one text (or record) per order with the wording
the extraction rules look for; they grow with the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.sources.star import Tables, company_name, padded, spread, word

ISSUES = [
    "VPN down, unable to connect to VPN through the tunnel",
    "login fails, password and SSO credentials rejected",
    "the portal is slow with timeout and high latency",
    "application crash and blue screen after the update",
    "invoice and billing payment charged twice",
    "refund credit missing for the subscription renewal",
    "disk full on storage, backup restore needed",
    "security breach suspected, unauthorized access denied",
    "printer and laptop setup need configuration",
    "network connectivity issue with packet loss",
    "email inbox is offline in Outlook",
    "general question about the roadmap",
]
MOODS = [
    "Thank you, great and helpful team.",
    "This is unacceptable, I am frustrated and angry.",
    "Please advise.",
    "Support was good but the tool is bad.",
    "Terrible service, worst ever.",
    "Happy with the fast reply, all resolved and smooth.",
    "It is an error, still broken, yet easy to appreciate.",
]
LEVELS = ["P1 urgent", "P2 major", "moderate", "P4 minor"]
DOMAINS = ["customer_intelligence", "it_operations", "document_contract"]


def pick(options: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (key % len(options) + 1).cast("int"))


def ticket_texts(t: Tables) -> DataFrame:
    """One text per order: a ticket, an outage report or a contract letter."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    first = word(cust.cast("string"))
    name = (
        F.when(key % 6 == 1, F.upper(first))
        .when(key % 6 == 2, F.concat(F.substring(first, 1, 3), F.substring(first, 5, 4)))
        .when(key % 6 == 3, F.concat(F.lit("Novel"), F.lower(word(F.concat(F.lit("n"), (cust % 40).cast("string"))))))
        .otherwise(first)
    )
    address = F.concat(F.lower(first), F.lit(".desk@example"), F.lit("."), pick(["com", "org"], key))
    day = F.col("o_orderdate")
    date = (
        F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 4 == 2, F.date_format(day, "MMM d, yyyy"))
        .otherwise(F.date_format(day, "M-d-yy"))
    )
    cents = F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    amount = (
        F.when(key % 3 == 0, F.concat(F.lit("$"), cents))
        .when(key % 3 == 1, F.concat(F.lit("EUR "), cents))
        .otherwise(F.concat(F.regexp_extract(cents, r"^\d+", 0), F.lit(" USD")))
    )
    number = (key % 9000).cast("string")
    outage = F.concat(
        (key % 50 + 1).cast("string"),
        F.when(key % 5 == 0, " hours of outage").otherwise(" minutes of downtime"),
    )
    issue, mood, level = pick(ISSUES, key), pick(MOODS, key), pick(LEVELS, key)
    who = F.when(key % 6 == 5, "").otherwise(F.concat(F.lit("Customer: "), name, F.lit(", ")))
    body = (
        F.when(
            key % 3 == 0,
            F.concat(
                F.lit("Ticket: TK-"), number, F.lit("\n"), who, F.lit("opened "), date, F.lit(".\n"),
                issue, F.lit(". Contact "), address, F.lit(". Amount "), amount, F.lit(".\n"), mood,
            ),
        )
        .when(
            key % 3 == 1,
            F.concat(
                F.lit("Incident #INC-"), number, F.lit(" "), level, F.lit("\n"), who, issue, F.lit(" on "),
                date, F.lit(" after "), outage, F.lit(".\nMajor Incident Team informed. "), mood,
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Contract CN-"), number, F.lit("/A signed "), date, F.lit(".\n"), who,
                F.lit("Service Level Agreement worth "), amount, F.lit(".\n"), issue, F.lit(". "), mood,
            )
        )
    )
    return spread(t.orders, costly=True).select(
        padded("TXT-", key).alias("document_id"),
        pick(DOMAINS, key).alias("domain"),
        day.alias("arrived_at"),
        body.alias("text"),
    )


def customer_registry(t: Tables) -> DataFrame:
    """Known customers: two-word company name, its first word as alias."""
    key = F.col("c_custkey")
    return spread(t.customer, costly=True).select(
        F.lit("customer").alias("entity_type"),
        padded("CUST_", key).alias("canonical_id"),
        company_name(key).alias("name"),
        F.array(word(key.cast("string"))).alias("aliases"),
    )


def service_registry(t: Tables) -> DataFrame:
    """Known services: one per supplier, with a two-word name and an alias."""
    seed = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    return spread(t.supplier, costly=True).select(
        F.lit("service").alias("entity_type"),
        padded("SVC_", F.col("s_suppkey")).alias("canonical_id"),
        F.concat_ws(" ", word(seed), word(seed, 9)).alias("name"),
        F.array(word(seed)).alias("aliases"),
    )


def service_mentions(t: Tables) -> DataFrame:
    """One mention per order line: the service named more or less correctly."""
    supp, how = F.col("l_suppkey"), F.col("l_partkey") % 10
    seed = F.concat(F.lit("s"), supp.cast("string"))
    # Words and whole name are columns of their own, made once a line and not once in every case.
    lines = spread(t.lineitem).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", word(seed).alias("_one"), word(seed, 9).alias("_two"))
    one, two, full = F.col("_one"), F.col("_two"), F.col("_full")
    raw = (
        F.when(how == 0, F.upper(full))
        .when(how == 1, F.concat(full, F.lit(", Ltd.")))
        .when(how == 2, one)
        .when(how == 3, F.concat_ws(" ", two, one))
        .when(how == 4, F.concat(F.substring(full, 1, 2), F.substring(full, 4, 20)))
        .when(how == 5, F.concat(F.lit("xyz"), F.substring(full, 4, 20)))
        .when(how == 6, F.concat(F.lit("vwxyzu"), F.substring(full, 7, 20)))
        .when(how == 7, F.concat(one, F.lit(" zzz")))
        .when(how == 8, F.concat_ws(" ", F.lit("Fresh"), word(F.concat(F.lit("f"), (supp % 20).cast("string")))))
        .otherwise(full)
    )
    return lines.withColumn("_full", F.concat_ws(" ", one, two)).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("document_id"),
        F.lit("service").alias("entity_type"),
        raw.alias("raw_value"),
        F.col("l_orderkey").alias("seen_order"),
    )


def dirty_tickets(t: Tables) -> DataFrame:
    """One all-text ticket record per order, with missing, malformed and repeated values."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    end = F.date_add(day.cast("date"), (key % 9 - 2).cast("int"))
    none = F.lit(None).cast("string")
    urgency = F.lower(F.element_at(F.split("o_orderpriority", "-"), 2))
    name = padded("Customer#", F.col("o_custkey"))
    return spread(t.orders).select(
        padded("R-", key).alias("row_id"),
        F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("TK-"), (key % 9000).cast("string"))).alias("ticket_number"),
        F.when(key % 13 == 0, none).otherwise(name).alias("customer_name"),
        F.when(key % 11 == 0, "").when(urgency == "not specified", "P3").otherwise(urgency).alias("priority"),
        pick(["open", "closed"], F.col("o_custkey")).alias("status"),
        F.when(key % 7 == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 7 == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key % 7 == 2, none)
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("created_date"),
        F.when(key % 10 == 0, none).otherwise(F.date_format(end, "yyyy-MM-dd")).alias("resolved_date"),
        F.when(key % 5 == 0, "no-at-sign.example").otherwise(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com"))
        ).alias("customer_email"),
        F.when(key % 8 == 0, "about 100").otherwise(
            F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(14,2)").cast("string"))
        ).alias("amount_currency"),
        F.when(key % 3 == 0, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("updated_at"),
    )


def model_replies(t: Tables) -> DataFrame:
    """A model's reply per document: plain, fenced, wrapped in prose, broken or empty."""
    key = F.col("doc_id")
    # a word of the document that is plain letters, so that it needs no escaping
    span = F.regexp_extract("text", r"[a-z]{4,}", 0)
    json = F.concat(
        F.lit('{"fields": [{"field": "topic", "value": "'), span,
        F.lit('", "confidence": 0.9, "text_span": "'), span,
        F.lit('"}, {"field": "lang", "value": "'), F.col("lang"), F.lit('"}'),
        F.when(key % 2 == 0, F.lit(', {"value": 7, "confidence": 0.4, "text_span": "#not there#"}')).otherwise(""),
        F.lit('], "entities": [{"type": "source", "value": "'), F.col("source"), F.lit('"}]'),
        F.when(key % 3 == 0, F.lit(', "sentiment": "positive", "sentiment_score": 0.83'))
        .when(key % 3 == 1, F.lit(', "sentiment": "neutral"')).otherwise(""),
        F.lit("}"),
    )
    reply = (
        F.when(key % 5 == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```")))
        .when(key % 5 == 2, F.concat(F.lit("Here is the result: "), json, F.lit(" Hope it helps.")))
        .when(key % 5 == 3, F.concat(F.lit("{\"fields\": [broken "), F.col("lang")))
        .when(key % 10 == 4, F.lit("no json here"))
        .otherwise(json)
    )
    return t.documents.select("doc_id", "text", reply.alias("raw"))


def ticket_replies(t: Tables) -> DataFrame:
    """A reply about a ticket for every document, with missing, extra and wrongly typed properties."""
    key = F.col("doc_id")
    number = F.concat(F.lit("TK-"), (key % 700).cast("string"))
    sure = pick(["\"high\"", "0.95", "null", "0.45"], key)
    json = F.concat(
        F.lit('{"fields": '),
        F.when(key % 11 == 5, F.lit('"none"')).otherwise(
            F.concat(
                F.lit('[{"field": "ticket_number", "value": "'), number, F.lit('", "confidence": '), sure,
                F.lit(', "note": {"page": 2}}, "stray", {"field": "severity", "value": "'), pick(["P1", "low", "odd"], key),
                F.lit('", "confidence": '), F.when(key % 5 == 0, "0.6").otherwise("0.8"), F.lit("}]"),
            )
        ),
        F.lit(', "sentiment": "'), pick(["negative", "neutral"], key), F.lit('", "sentiment_score": '),
        F.when(key % 9 == 4, F.lit('"much"')).otherwise("0.25"),
        F.lit(', "topics": '), F.when(key % 7 == 3, F.lit('"alone"')).otherwise(F.concat(F.lit('["b", 7, "t'), (key % 5).cast("string"), F.lit('"]'))),
        F.lit(', "extra": [1, {"a": null}]}'),
    )
    return t.documents.select(
        padded("DOC-", key).alias("document_id"),
        F.lit("customer_intelligence").alias("domain"),
        F.timestamp_add("MINUTE", key.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("arrived_at"),
        "text",
        F.when(key % 13 == 6, F.concat(F.lit("[1, "), json, F.lit(", 2"))).when(key % 13 == 7, F.lit("[1, 2]")).otherwise(json).alias("raw"),
    )


def upload_files(t: Tables) -> DataFrame:
    """The documents as uploaded files of several types, some not allowed, some without one."""
    key = F.col("doc_id")
    ending = pick([".txt", ".json", ".PDF", "", ".tar.exe", ".csv"], key)
    return t.documents.select(
        padded("DOC-", key).alias("document_id"),
        F.concat(F.lit("up/"), key.cast("string"), ending).alias("filename"),
        F.col("text").alias("content"),
        (key % 2).alias("run"),
    )


def document_records(t: Tables) -> DataFrame:
    """The records of :func:`dirty_tickets` as rows of documents of two thousand keys and three domains."""
    block = F.floor(F.substring("row_id", 3, 18).cast("long") / 2000)
    return dirty_tickets(t).select(
        F.concat(F.lit("DOC-"), block.cast("string")).alias("document_id"),
        F.concat(F.lit("part-"), block.cast("string"), F.lit(".csv")).alias("dataset_name"),
        pick(["customer_intelligence", "it_operations", "ticket"], block).alias("domain"),
        "*",
    ).drop("row_id")


QUESTIONS = [
    "Which customers have the highest support risk?",
    "Summarise incidents of the last month",
    "Which services have worsening sentiment?",
    "Show customers with SLA breaches and negative sentiment",
    "Give me a platform overview",
    "What is the weather",
    "Most negative product lines",
]


def questions(t: Tables) -> DataFrame:
    """One question per conversation turn, followed by the turn's own text."""
    key = F.col("conv_id") + F.col("turn")
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        F.concat_ws(" ", pick(QUESTIONS, key), "text").alias("question"),
    )
