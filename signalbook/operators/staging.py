"""From documents to staged fields, review items and fact rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions import extract as ex
from signalbook.functions import lexicon
from signalbook.functions.text import normalize_severity, normalize_text, word_count
from signalbook.functions.values import blank_to_null, half_up, once, stable_id
from signalbook.session import exchanged
from signalbook.sources.replies import read_replies

CONF = fv.FIELD_CONFIDENCE
TICKET_DOMAIN = "customer_intelligence"
INCIDENT_DOMAIN = "it_operations"
CONTRACT_DOMAIN = "document_contract"


def _field(name: str, value: Column, confidence, span: int, placed: bool) -> Column:
    """A field struct; the span is the head of the text it was read from."""
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit(name).alias("field"),
        value.cast("string").alias("value"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
        F.substring("text", 1, span).alias("text_span"),
        (F.lit(0) if placed else none).alias("char_start"),
        (F.least(F.lit(span), F.length("text")) if placed else none).alias("char_end"),
    )


def _found(domain: str, name: str, value: Column) -> Column:
    made = once(
        value, lambda v: F.when(v.isNotNull(), _field(name, v, CONF[name], 100, placed=False))
    )
    return F.when(F.col("domain") == domain, made)


def extract(
    documents: DataFrame,
    positive: Sequence[str] = fv.POSITIVE_WORDS,
    negative: Sequence[str] = fv.NEGATIVE_WORDS,
    topic_patterns: Mapping[str, Sequence[str]] = fv.TOPIC_PATTERNS,
    max_chars: int | None = None,
    keep: Mapping[str, int] = {},
    with_text: bool = False,
) -> DataFrame:
    """Rule-based extraction, one row per document (document_id, domain, text, ...).

    Row-local and free of Python.  ``max_chars`` would cut the text first, as a
    front end with a size limit does; by default the whole text is read.  ``keep`` limits the number
    of topics, dates, money or key_phrases; by default all are kept.  ``with_text`` keeps the text as well.
    """
    docs = documents
    if max_chars is not None:
        docs = docs.withColumn("text", F.substring("text", 1, max_chars))
    text, matched = F.col("text"), F.col("_matched")
    vocabulary = lexicon.vocabulary(positive, negative, topic_patterns)
    searched = docs.withColumn("_matched", lexicon.found(text, vocabulary))
    read = searched.select(
        *docs.columns,
        lexicon.sentiment_of(matched, positive, negative).alias("_mood"),
        lexicon.severity_of(matched).alias("_level"),
        lexicon.topics_of(matched, topic_patterns, keep.get("topics")).alias("topics"),
        lexicon.issue_class_of(matched).alias("_issue"),
        ex.customer_name(text).alias("customer_name"),
        ex.dates(text, keep.get("dates")).alias("dates"),
        ex.money(text, keep.get("money")).alias("money"),
    )
    topics = F.col("topics")
    fields = F.array_compact(
        F.array(
            _field("sentiment", F.col("_mood.label"), F.col("_mood.confidence"), 200, True),
            _field("severity", F.col("_level.level"), F.col("_level.confidence"), 200, True),
            _field(
                "topics",
                F.to_json(topics),
                F.when(F.size(topics) > 0, CONF["topics"]).otherwise(CONF["no_topics"]),
                200,
                True,
            ),
            _found(TICKET_DOMAIN, "ticket_number", ex.ticket_number(text)),
            _found(TICKET_DOMAIN, "customer_email", ex.email(text)),
            _found(INCIDENT_DOMAIN, "incident_number", ex.incident_number(text)),
            _found(INCIDENT_DOMAIN, "downtime_minutes", ex.downtime_minutes(text)),
            _found(CONTRACT_DOMAIN, "contract_number", ex.contract_number(text)),
        )
    )

    def entity(kind: str, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), value.alias("value"), F.lit(CONF[kind]).alias("confidence")
        )

    name = F.col("customer_name")
    entities = F.concat(
        F.array_compact(F.array(F.when(name.isNotNull(), entity("customer", name)))),
        F.transform("dates", lambda d: entity("date", d)),
        F.transform("money", lambda m: entity("monetary_value", m)),
    )
    rest = [c for c in docs.columns if with_text or c != "text"]
    total = F.aggregate("fields", F.lit(0.0), lambda a, f: a + f.confidence)
    return (
        read.select(
            *rest,
            F.col("_mood.label").alias("sentiment"),
            F.col("_mood.score").alias("sentiment_score"),
            F.col("_level.level").alias("severity"),
            "topics",
            F.col("_issue.category").alias("category"),
            F.col("_issue.subcategory").alias("subcategory"),
            "customer_name",
            fields.alias("fields"),
            entities.alias("entities"),
            ex.key_phrases(text, keep.get("key_phrases")).alias("key_phrases"),
            ex.summary(text).alias("summary"),
            word_count(text).alias("word_count"),
            F.ceil(F.size(F.split(text, "\n", -1)) / fv.LINES_PER_PAGE).cast("int").alias("pages"),
        )
        .withColumn("overall_confidence", half_up(total / F.size("fields"), 2))
    )


def extract_replies(documents: DataFrame, raw: str = "raw", fallback: bool = True) -> DataFrame:
    """Extraction from a model's replies, in the rows and columns of :func:`extract`.

    The customer is the field customer_name or company, else the first customer or company entity;
    category and subcategory are those of the issue described.  A document whose reply cannot be read
    is extracted by the rules (``fallback``), or has no fields.
    """
    docs = documents.drop(raw)
    replied = read_replies(documents, raw, "text")
    read = replied.filter(F.col("_r").isNotNull()) if fallback else replied
    none = F.array().cast("array<string>")
    is_customer = lambda e: e.type.isin("customer", "company")
    issue = lexicon.issue_class_of(
        lexicon.found(F.coalesce(field_value("issue_description"), F.lit("")), lexicon.issue_words())
    )
    rest = [c for c in docs.columns if c != "text"]
    found = read.withColumn("_issue", issue).select(
        *rest,
        F.col("_r.sentiment").alias("sentiment"),
        F.col("_r.sentiment_score").alias("sentiment_score"),
        F.coalesce(field_value("severity"), F.lit("medium")).alias("severity"),
        F.coalesce("_r.topics", none).alias("topics"),
        F.col("_issue.category").alias("category"),
        F.col("_issue.subcategory").alias("subcategory"),
        F.coalesce(
            blank_to_null(field_value("customer_name")),
            blank_to_null(field_value("company")),
            F.try_element_at(F.filter("entities", is_customer), F.lit(1)).getField("value"),
        ).alias("customer_name"),
        "fields",
        "entities",
        F.coalesce("_r.key_phrases", none).alias("key_phrases"),
        F.coalesce("_r.summary", F.lit("")).alias("summary"),
        word_count(F.col("text")).alias("word_count"),
        F.ceil(F.size(F.split("text", "\n", -1)) / fv.LINES_PER_PAGE).cast("int").alias("pages"),
        "overall_confidence",
    )
    if not fallback:
        return found
    unread = replied.filter(F.col("_r").isNull()).select(*docs.columns)
    return found.unionByName(extract(unread))


def field_value(name: str) -> Column:
    """Value of the first field of that name, else null."""
    hits = F.filter("fields", lambda f: f.field == name)
    return F.try_element_at(hits, F.lit(1)).getField("value")


def staged_entities(extracted: DataFrame) -> DataFrame:
    """Every field and entity as a row with its review status."""
    base = ["document_id", "domain"]
    # explode_outer: a plain explode would add a filter on the array and so
    # compute the whole extraction twice.
    fields = extracted.select(*base, F.explode_outer("fields").alias("f")).select(
        *base,
        F.lit("field").alias("origin"),
        F.col("f.field").alias("entity_type"),
        F.col("f.value").alias("raw_value"),
        "f.confidence",
        F.lit(1).alias("source_page"),
        F.col("f.text_span").alias("source_text_span"),
        "f.char_start",
        "f.char_end",
        F.when(F.col("f.confidence") >= fv.AUTO_ACCEPT_CONFIDENCE, "auto_accepted")
        .otherwise("pending_review")
        .alias("review_status"),
    )
    none = F.lit(None)
    entities = extracted.select(*base, F.explode_outer("entities").alias("e")).filter(
        F.col("e").isNotNull()
    ).select(
        *base,
        F.lit("entity").alias("origin"),
        F.col("e.type").alias("entity_type"),
        F.col("e.value").alias("raw_value"),
        "e.confidence",
        none.cast("int").alias("source_page"),
        none.cast("string").alias("source_text_span"),
        none.cast("int").alias("char_start"),
        none.cast("int").alias("char_end"),
        F.lit("auto_accepted").alias("review_status"),
    )
    return fields.unionByName(entities)


def _percent(confidence: Column) -> Column:
    return F.round(F.round(confidence * 100, 6), 0).cast("int").cast("string")


def low_confidence_items(extracted: DataFrame) -> DataFrame:
    """Review items for fields below the review limit."""
    weak = F.filter("fields", lambda f: f.confidence < fv.REVIEW_CONFIDENCE)
    return extracted.select("document_id", F.explode_outer(weak).alias("f")).filter(
        F.col("f").isNotNull()
    ).select(
        F.lit("low_confidence_extraction").alias("item_type"),
        "document_id",
        F.concat(F.lit("Low-confidence extraction: "), "f.field").alias("title"),
        F.concat(
            F.lit("Field '"), "f.field", F.lit("' extracted with "),
            _percent(F.col("f.confidence")), F.lit("% confidence"),
        ).alias("description"),
        F.col("f.value").alias("current_value"),
        F.lit(None).cast("string").alias("suggested_value"),
        F.col("f.confidence").alias("confidence"),
        F.when(F.col("f.confidence") < fv.URGENT_REVIEW_CONFIDENCE, "high")
        .otherwise("medium")
        .alias("priority"),
    )


def review_queue(*items: DataFrame) -> DataFrame:
    """All review items with a stable id and pending status."""
    out = items[0]
    for more in items[1:]:
        out = out.unionByName(more)
    key = stable_id(F.col("item_type"), F.col("document_id"), F.col("title"))
    return out.select(key.alias("item_id"), "*", F.lit("pending").alias("status"))


def customer_mentions(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("customer_name").isNotNull()).select(
        "document_id",
        F.lit("customer").alias("entity_type"),
        F.col("customer_name").alias("raw_value"),
        F.struct("arrived_at", "document_id").alias("seen_order"),
    )


def with_customer(extracted: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add the canonical id of the customer named in the document, null if there is none.

    Documents that name nobody would all meet under the null key: they are spread over keys of their
    own.  A filter instead would go below what makes the name, and make it twice.
    """
    name = F.col("customer_name")
    ids = decisions.filter((F.col("entity_type") == "customer") & F.col("raw_value").isNotNull()).select(
        F.col("raw_value").alias("_who"), F.lit(True).alias("_named"), F.col("canonical_id").alias("customer_code")
    )
    who = F.coalesce(name, F.col("document_id").cast("string"))
    named = extracted.withColumn("_who", who).withColumn("_named", name.isNotNull())
    coded = named.join(exchanged(ids), ["_who", "_named"], "left").drop("_who", "_named")
    return coded.select(name, *[c for c in coded.columns if c != "customer_name"])


def _auto_number(prefix: str) -> Column:
    """A number for a document without one: the whole hash of its id, so no two documents share it."""
    return F.concat(F.lit(prefix), F.upper(F.md5("document_id")))


def _title() -> Column:
    """The issue described in the document, else the document's id."""
    return normalize_text(F.coalesce(field_value("issue_description"), F.col("document_id").cast("string")))


def first_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The earliest row of every key, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(key).agg(first).select(key, "_r.*")


def insert_absent(new: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key the target does not hold."""
    if existing is None:
        return new
    return new.join(existing.select(key), key, "left_anti")


def ticket_facts(extracted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New tickets of the customer domain, one per number: the earliest document wins."""
    number = F.coalesce(field_value("ticket_number"), _auto_number("TK-AUTO-"))
    level = normalize_severity(F.col("severity"))
    rows = extracted.filter(F.col("domain") == TICKET_DOMAIN).select(
        number.alias("ticket_number"),
        "document_id",
        "arrived_at",
        "customer_code",
        _title().alias("title"),
        level.alias("priority"),
        level.alias("severity"),
        F.lit("open").alias("status"),
        "category",
        "subcategory",
        "sentiment",
        "sentiment_score",
        F.col("topics").alias("tags"),
        F.col("subcategory").alias("root_cause_category"),
        F.col("overall_confidence").alias("extraction_confidence"),
    )
    return insert_absent(
        first_per_key(rows, "ticket_number", ["arrived_at", "document_id"]), existing, "ticket_number"
    )


def incident_facts(extracted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New incidents of the operations domain, one per number."""
    number = F.coalesce(field_value("incident_number"), _auto_number("INC-AUTO-"))
    minutes = field_value("downtime_minutes").try_cast("double")
    rows = extracted.filter(F.col("domain") == INCIDENT_DOMAIN).select(
        number.alias("incident_number"),
        "document_id",
        "arrived_at",
        _title().alias("title"),
        normalize_severity(F.col("severity")).alias("severity"),
        F.lit("open").alias("status"),
        "category",
        "subcategory",
        F.when(minutes != 0, minutes).alias("downtime_minutes"),
        F.col("subcategory").alias("root_cause_category"),
        F.lit(False).alias("sla_breached"),
        F.col("overall_confidence").alias("extraction_confidence"),
    )
    return insert_absent(
        first_per_key(rows, "incident_number", ["arrived_at", "document_id"]),
        existing,
        "incident_number",
    )


def contract_facts(extracted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New contracts of the contract domain, one per number found."""
    rows = (
        extracted.filter(F.col("domain") == CONTRACT_DOMAIN)
        .select(
            field_value("contract_number").alias("contract_number"),
            "document_id",
            "arrived_at",
            "customer_code",
            F.lit("active").alias("status"),
            F.col("overall_confidence").alias("extraction_confidence"),
        )
        # A filter on the number would go below what makes the fields, and make them twice.
        .withColumn("_numbered", F.col("contract_number").isNotNull())
    )
    first = first_per_key(rows, "contract_number", ["arrived_at", "document_id"]).where("_numbered")
    return insert_absent(first.drop("_numbered"), existing, "contract_number")


def feedback_facts(extracted: DataFrame) -> DataFrame:
    """One feedback row per document that has a sentiment, with its whole text."""
    row = F.struct(
        stable_id(F.lit("feedback"), F.col("document_id")).alias("feedback_id"),
        "document_id",
        "customer_code",
        F.coalesce("domain", F.lit("document")).alias("feedback_type"),
        F.col("text").alias("raw_text"),
        "sentiment",
        "sentiment_score",
        "topics",
        "key_phrases",
        F.col("overall_confidence").alias("extraction_confidence"),
    )
    # Not a filter on the sentiment: it would go below what makes it, and search the text twice.
    held = F.array(F.when(F.col("sentiment").isNotNull(), row))
    return extracted.select(F.explode_outer(held).alias("f")).filter(F.col("f").isNotNull()).select("f.*")


def run_summary(extracted: DataFrame) -> DataFrame:
    """Pages, words and entities per domain and sentiment of a run."""
    return extracted.groupBy("domain", "sentiment").agg(
        F.count("*").alias("documents"),
        F.sum("pages").alias("pages"),
        F.sum("word_count").alias("words"),
        F.sum(F.size("fields") + F.size("entities")).alias("entities_extracted"),
        F.count_if(F.size("topics") > 0).alias("with_topics"),
        half_up(F.avg(F.col("overall_confidence").cast("decimal(10,2)")), 2).alias("confidence"),
    )


def provenance_links(staged: DataFrame, facts: DataFrame, table: str, key: str) -> DataFrame:
    """Where each stored fact came from: document, page, field and character range."""
    fields = staged.filter(F.col("origin") == "field")
    return facts.select("document_id", F.col(key).alias("target_id")).join(
        fields, "document_id"
    ).select(
        stable_id(F.lit(table), F.col("target_id"), F.col("entity_type")).alias("link_id"),
        "document_id",
        F.lit(table).alias("target_table"),
        "target_id",
        F.col("entity_type").alias("field_name"),
        "source_page",
        "char_start",
        "char_end",
        "confidence",
    )
