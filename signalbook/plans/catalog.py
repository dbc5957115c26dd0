"""Every query by name, over the tables of one folder.

Arrays are given out as joined text and times as text, so that results compare
the same way in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.functions import extract as ex
from signalbook.functions import lexicon, text as tx
from signalbook.functions.values import half_up, instant, stable_id
from signalbook.operators import causes, health, impact, profile, quality, registry, resolve, serving
from signalbook.operators import series, staging, topics, uploads
from signalbook.plans import insights as ins
from signalbook.plans.analysis import full_analysis, scored_customers
from signalbook.plans.intake import Run, document_run
from signalbook.plans.questions import answer, intent
from signalbook.session import cut_lineage, scratch_path
from signalbook.sources import files, star, texts
from signalbook.sources.replies import parse_replies
from signalbook.sources.star import Tables
from signalbook.streaming import jobs

AS_OF = "2000-01-01 00:00:00"
WINDOW_DAYS = 365
TOPICS_AS_OF = "2024-01-31 00:00:00"
COMPONENT_LINK = 70
TOPIC_DAYS = 7

# Words that English documents of the corpus hold, as a stand-in word list.
CORPUS_POSITIVE = ["that", "from", "have"]
CORPUS_NEGATIVE = ["this", "with", "not"]
CORPUS_TOPICS = {"place": ["where", "there", "here"], "time": ["when", "then", "while"], "und": ["und", "der"], "que": ["que", "los"]}

Query = Callable[[Tables], DataFrame]
CATALOG: dict[str, Query] = {}


def query(build: Query) -> Query:
    CATALOG[build.__name__] = build
    return build


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def joined(values: Column, by: str = " ; ") -> Column:
    return F.array_join(values, by)


def key_chunk(column: str, size: int = 1_000_000) -> Column:
    return F.floor(F.col(column) / size)


# --- shared frames -------------------------------------------------------------------


def _scored(t: Tables) -> DataFrame:
    return scored_customers(
        star.dim_customer(t), star.fact_ticket(t), star.incident_events(t), instant(AS_OF), WINDOW_DAYS
    )


def _overview(t: Tables) -> DataFrame:
    """All counts of the overviews: nothing is written or run before the result is asked for."""
    rows = health.whole_activity(
        star.dim_customer(t),
        health.ticket_activity(star.fact_ticket(t), instant(AS_OF), WINDOW_DAYS),
        health.incident_activity(star.incident_events(t), instant(AS_OF), WINDOW_DAYS),
    )
    return serving.activity_overview(health.customer_health(rows), ins.notable_health())


def _health(t: Tables, at: str = AS_OF) -> DataFrame:
    metrics = health.customer_metrics(
        star.dim_customer(t), star.fact_ticket(t), star.incident_events(t), instant(at), WINDOW_DAYS
    )
    return health.customer_health(metrics)


def _health_insights(t: Tables) -> DataFrame:
    return ins.health_insights(_health(t), instant(AS_OF))


def _records(t: Tables) -> DataFrame:
    """Tickets with the product category, for the sentiment rollup."""
    category = star.dim_product(t).select("product_id", F.col("product_category").alias("category"))
    return star.fact_ticket(t).join(category, "product_id", "left")


def _rollup(t: Tables) -> DataFrame:
    return serving.sentiment_rollup(_records(t))


def _service_rollup(t: Tables) -> DataFrame:
    return serving.sentiment_rollup(star.fact_ticket(t), scopes=["service_id"])


def _overall_rollup(t: Tables) -> DataFrame:
    return serving.sentiment_rollup(star.fact_ticket(t), scopes=[])


TEXT_SCOPES = ["domain", "category"]


def _text_records(t: Tables) -> DataFrame:
    return _extracted(t).select("arrived_at", *TEXT_SCOPES, "topics", "sentiment", "sentiment_score")


@query
def topics_by_scope(t: Tables) -> DataFrame:
    """Top topics of every month, overall, per domain and per category."""
    return serving.top_topics(_text_records(t), "arrived_at", scopes=TEXT_SCOPES).withColumn("period_start", stamp(F.col("period_start")))


@query
def rollup_with_topics(t: Tables) -> DataFrame:
    """Monthly sentiment of the texts with the top topics of every row."""
    records = cut_lineage(_text_records(t))
    rolled = serving.sentiment_rollup(records, "arrived_at", scopes=TEXT_SCOPES)
    tops = serving.top_topics(records, "arrived_at", scopes=TEXT_SCOPES)
    found = serving.with_top_topics(rolled, tops, TEXT_SCOPES).drop("period_end", "period_type")
    return found.withColumn("period_start", stamp(F.col("period_start"))).withColumn("top_topics", joined(F.col("top_topics")))


def _hourly(t: Tables) -> DataFrame:
    return series.metric_series(t.events, ["event_type"], "ts", "value", "hour")


def _month_chunk() -> Column:
    return F.date_trunc("month", "t")


def _counts(t: Tables) -> DataFrame:
    return topics.topic_counts(star.event_topics(t), instant(TOPICS_AS_OF), TOPIC_DAYS, TOPIC_DAYS)


def _causes(t: Tables) -> DataFrame:
    return causes.root_causes(star.fact_incident(t))


def _run(t: Tables) -> Run:
    return document_run(texts.ticket_texts(t), texts.customer_registry(t))


def _extracted(t: Tables) -> DataFrame:
    return staging.extract(texts.ticket_texts(t))


def _pending_reviews(t: Tables) -> DataFrame:
    """Review items of the texts, stored once: their readers ask for them several times, and each would extract anew."""
    return cut_lineage(staging.review_queue(staging.low_confidence_items(_extracted(t))))


def _service_names(t: Tables) -> DataFrame:
    return resolve.distinct_names(texts.service_mentions(t), "seen_order")


# --- sources and profiles ----------------------------------------------------------------


@query
def scan_csv_profile(t: Tables) -> DataFrame:
    """Orders written as CSV with missing-value words, scanned back and profiled."""
    path = scratch_path(t.spark, "orders-csv")
    flawed = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_custkey",
        F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"),
    )
    files.write_csv(flawed, path)
    scanned = files.read_csv(t.spark, path)
    order = scanned.withColumn("_n", F.col("o_orderkey").cast("bigint"))
    found = profile.column_profile(order, ["_n"]).filter(F.col("column_name") != "_n")
    return found.withColumn("sample_values", joined(F.col("sample_values")))


@query
def scan_by_format(t: Tables) -> DataFrame:
    """Documents written and read back in every format by the reader registry."""
    out = None
    base = t.documents
    for kind in ("csv", "json", "parquet"):
        path = scratch_path(t.spark, f"documents-{kind}")
        if kind == "csv":
            files.write_csv(base, path)
        else:
            base.write.format(kind).save(path)
        back = (
            files.read_csv(t.spark, path, multi_line=True) if kind == "csv" else files.read_by_format(t.spark, path, kind)
        )
        row = back.agg(
            F.lit(kind).alias("format"),
            F.count("*").alias("n_rows"),
            F.count("text").alias("n_texts"),
            F.count_distinct("lang").alias("n_langs"),
            F.sum(F.length("text")).alias("n_chars"),
            F.count_distinct("doc_id").alias("n_ids"),
            F.count_distinct("source").alias("n_sources"),
            F.sum(F.col("n_chars").cast("bigint")).alias("stated_chars"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query
def text_pages(t: Tables) -> DataFrame:
    return profile.text_pages(star.spread(t.documents), "doc_id", lines_per_page=5)


@query
def rows_to_text(t: Tables) -> DataFrame:
    """Orders as text, in pages of 50 rows per month."""
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("document_id"),
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderpriority")).otherwise("").alias("o_orderpriority"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )
    return profile.rows_to_text(rows, ["document_id"], ["o_orderkey"], key_chunk("o_orderkey"))


@query
def column_profile(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    shown = rows.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"),
    )
    found = profile.column_profile(shown, ["o_orderkey"])
    return found.drop("dtype").withColumn("sample_values", joined(F.col("sample_values")))


@query
def duplicate_rows(t: Tables) -> DataFrame:
    """Repeated lines, all columns compared, once every line has been put in a second time if its
    order is a multiple of three."""
    again = t.lineitem.filter(F.col("l_orderkey") % 3 == 0)
    return profile.dataset_metadata(t.lineitem.unionByName(again))


@query
def raw_records(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
    )
    return profile.raw_records(rows, "month", ["o_orderkey"], key_chunk("o_orderkey"))


@query
def dedup_by_hash(t: Tables) -> DataFrame:
    return profile.dedup_by_hash(t.documents, "text", ["doc_id"])


@query
def parse_model_json(t: Tables) -> DataFrame:
    parsed = parse_replies(texts.model_replies(t), "doc_id", "raw", "text")
    none = F.lit("null")
    cell = lambda c: F.coalesce(c.cast("string"), none)
    return parsed.select(
        "doc_id",
        "parsed",
        joined(
            F.transform(
                "fields",
                lambda f: F.concat_ws(
                    "|", f.field, cell(f.value), cell(f.confidence), cell(f.char_start), cell(f.char_end)
                ),
            )
        ).alias("fields"),
        joined(F.transform("entities", lambda e: F.concat_ws("|", e.type, e.value, e.confidence.cast("string")))).alias("entities"),
        "overall_confidence",
    )


def _replied(t: Tables) -> DataFrame:
    return staging.extract_replies(texts.ticket_replies(t), fallback=False)


@query
def reply_facts(t: Tables) -> DataFrame:
    """Ticket facts from model replies, whatever properties these have."""
    facts = staging.ticket_facts(_replied(t).withColumn("customer_code", F.lit(None).cast("string")))
    return facts.select(
        "ticket_number", "document_id", "severity", "sentiment", "sentiment_score", joined(F.col("tags")).alias("tags"), "extraction_confidence"
    )


@query
def reply_reviews(t: Tables) -> DataFrame:
    """Review items for the uncertain fields of model replies."""
    items = staging.review_queue(staging.low_confidence_items(_replied(t)))
    return items.select("item_id", "document_id", "title", "description", "current_value", "confidence", "priority", "status")


UPLOAD_BYTES = 3000


@query
def upload_intake(t: Tables) -> DataFrame:
    """Documents uploaded in two runs; the second knows what the first stored."""
    found = texts.upload_files(t)
    first = cut_lineage(uploads.intake(found.filter("run = 0"), ["document_id"], max_bytes=UPLOAD_BYTES))
    known = uploads.stored_files(first)
    return first.unionByName(uploads.intake(found.filter("run = 1"), ["document_id"], max_bytes=UPLOAD_BYTES, known=known))


# --- lists ---------------------------------------------------------------------------------


@query
def customer_search(t: Tables) -> DataFrame:
    """High-risk customers whose name holds a pattern."""
    risky = serving.where_equal(_scored(t), risk_level="high".upper())
    return serving.name_contains(risky, "mer#0000__1").select(
        "canonical_id", "name", "risk_level", "health_score"
    )


@query
def customer_list(t: Tables) -> DataFrame:
    """First page of customers by falling contract value."""
    rows = star.dim_customer(t).select(
        "canonical_id", "name", "company", "region", "tier", "is_active",
        F.col("contract_value").cast("double").alias("contract_value"),
    )
    return serving.page(rows, [F.desc_nulls_last("contract_value"), F.asc("canonical_id")])


@query
def incident_list(t: Tables) -> DataFrame:
    """Second page of breached P1 incidents, newest first, with the total."""
    rows = serving.where_equal(star.fact_incident(t), severity="P1", status=None, sla_breached=True)
    order = [F.desc("occurred_at"), F.asc("incident_id")]
    shown = serving.page(rows, order, number=2)
    return shown.select(
        "incident_id", "incident_number", "severity", "status", "category", "subcategory",
        stamp(F.col("occurred_at")).alias("occurred_at"), "downtime_minutes", "sla_breached",
        "root_cause", "total",
    )


@query
def deep_page(t: Tables) -> DataFrame:
    """Page 30 of all orders by value, from the stored ranges of the list."""
    path = scratch_path(t.spark, "pages")
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    serving.store_pages(rows, [F.asc("o_orderpriority"), F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], path)
    return serving.page_at(t.spark, path, number=30)


@query
def insight_list(t: Tables) -> DataFrame:
    """First page of active high-severity risk insights."""
    rows = serving.where_equal(
        _health_insights(t), severity="HIGH", insight_type="risk", status="active"
    )
    shown = serving.page(rows, [F.desc("priority_score"), F.asc("insight_id")])
    return shown.select("insight_id", "title", "severity", "priority_score", "current_value", "total")


@query
def document_list(t: Tables) -> DataFrame:
    rows = serving.where_equal(star.raw_documents(t), domain="en", status="completed")
    shown = serving.page(rows, [F.desc("created_at"), F.asc("document_id")])
    return shown.select(
        "document_id", "filename", "file_type", "file_size_bytes", "status",
        stamp(F.col("created_at")).alias("created_at"), "total",
    )


@query
def job_list(t: Tables) -> DataFrame:
    """Failed processing jobs, newest first, third page."""
    jobs_ = star.raw_documents(t).select(
        stable_id(F.lit("job"), F.col("document_id")).alias("job_id"),
        "document_id", "status", "created_at",
    )
    shown = serving.page(
        serving.where_equal(jobs_, status="failed"), [F.desc("created_at"), F.asc("job_id")], number=3
    )
    return shown.withColumn("created_at", stamp(F.col("created_at")))


@query
def review_list(t: Tables) -> DataFrame:
    """First page of pending review items, most urgent and least certain first."""
    items = _pending_reviews(t)
    rows = serving.where_equal(items, status="pending")
    shown = serving.page(rows, [F.asc("priority"), F.asc("confidence"), F.asc("item_id")])
    return shown.select("item_id", "item_type", "title", "description", "confidence", "priority", "total")


@query
def anomaly_list(t: Tables) -> DataFrame:
    """Newest anomalies of any metric."""
    found = series.zscore_anomalies(_hourly(t), ["event_type"])
    shown = serving.page(found, [F.desc("t"), F.asc("event_type")])
    return shown.select(
        F.col("event_type").alias("metric_name"), stamp(F.col("t")).alias("detected_at"),
        "value", "expected", "deviation_pct", "severity", "total",
    )


# --- KPIs and rollups ---------------------------------------------------------------------------


@query
def kpi_overview(t: Tables) -> DataFrame:
    return _overview(t).drop("active_insights")


@query
def ask_overview(t: Tables) -> DataFrame:
    return _overview(t).select(
        F.col("total_customers").alias("customers"), F.col("total_tickets").alias("tickets"),
        F.col("total_incidents").alias("incidents"), "active_insights",
    )


@query
def health_distribution(t: Tables) -> DataFrame:
    """Customers per risk level; customers without a contract have no level."""
    rows = _scored(t).withColumn(
        "risk_level", F.when(F.col("contract_value") > 0, F.col("risk_level"))
    )
    return serving.health_distribution(rows)


@query
def kpi_total_customers(t: Tables) -> DataFrame:
    return t.customer.agg(F.count_distinct("c_custkey").alias("total_customers"))


@query
def kpi_avg_health(t: Tables) -> DataFrame:
    score = F.col("health_score").cast("decimal(10,1)")
    return _scored(t).agg(half_up(F.avg(score), 2).alias("avg_health_score"))


@query
def customer_risk(t: Tables) -> DataFrame:
    return serving.customers_by_risk(_scored(t))


@query
def sla_breach_matrix(t: Tables) -> DataFrame:
    return serving.breach_matrix(star.incident_events(t))


@query
def churn_matrix(t: Tables) -> DataFrame:
    return serving.churn_matrix(_scored(t))


@query
def sentiment_rollup(t: Tables) -> DataFrame:
    rolled = _rollup(t)
    return rolled.withColumn("period_start", stamp(F.col("period_start"))).withColumn(
        "period_end", stamp(F.col("period_end"))
    )


@query
def sentiment_long(t: Tables) -> DataFrame:
    return serving.sentiment_long(_overall_rollup(t))


@query
def sentiment_trend_12(t: Tables) -> DataFrame:
    return serving.latest_months(_overall_rollup(t))


@query
def sentiment_top_topics(t: Tables) -> DataFrame:
    """Most frequent topics of the operational texts per month."""
    found = serving.top_topics(_extracted(t), "arrived_at")
    return found.withColumn("period_start", stamp(F.col("period_start")))


@query
def customer_metrics(t: Tables) -> DataFrame:
    found = health.customer_metrics(
        star.dim_customer(t), star.fact_ticket(t), star.incident_events(t), instant(AS_OF), WINDOW_DAYS
    )
    return found.withColumn("avg_resolution_hours", half_up(F.col("avg_resolution_hours"), 6)).withColumn(
        "negative_pct", half_up(F.col("negative_pct"), 6)
    )


@query
def service_metrics(t: Tables) -> DataFrame:
    found = health.service_metrics(
        star.dim_service(t), star.fact_ticket(t), star.fact_incident(t), instant(AS_OF), WINDOW_DAYS
    )
    return found.withColumn("top_root_causes", joined(F.col("top_root_causes")))


@query
def document_status(t: Tables) -> DataFrame:
    return serving.document_status(star.raw_documents(t))


@query
def complete_rows(t: Tables) -> DataFrame:
    rows = _scored(t).withColumn(
        "revenue_at_risk", F.when(F.col("risk_level") != "LOW", F.col("revenue_at_risk"))
    )
    return serving.complete_rows(rows, ["contract_value", "health_score", "churn_risk_score", "revenue_at_risk"])


# --- canned questions ------------------------------------------------------------------------------


@query
def top_risk_customers(t: Tables) -> DataFrame:
    return serving.top_risk_customers(_scored(t)).select(
        "canonical_id", "name", "risk_level", "health_score", "churn_risk_score", "revenue_at_risk"
    )


@query
def recent_incidents(t: Tables) -> DataFrame:
    return serving.recent_incidents(star.incident_events(t), instant("2001-11-04 00:00:00"))


@query
def negative_services(t: Tables) -> DataFrame:
    found = serving.negative_services(_service_rollup(t))
    return found.select("service_id", stamp(F.col("period_start")).alias("period_start"), "negative_pct", "total_records")


@query
def sla_and_sentiment(t: Tables) -> DataFrame:
    return serving.breach_and_sentiment(star.fact_ticket(t))


@query
def ask_recent_incidents(t: Tables) -> DataFrame:
    """A question in words, by way of its intent."""
    return answer(
        "How many incidents were there in the last month?",
        _scored(t), star.fact_ticket(t), star.incident_events(t), _health_insights(t), _service_rollup(t),
        instant("2001-11-04 00:00:00"),
    )


@query
def tag_questions(t: Tables) -> DataFrame:
    return texts.questions(t).select("question_id", intent(F.col("question")).alias("intent"))


# --- joins, extracts and updates ----------------------------------------------------------------------


@query
def bi_customers(t: Tables) -> DataFrame:
    """Customers with the newest of two health snapshots."""
    columns = ["customer_id", "health_score", "risk_level", "trend", "ticket_count", "incident_count", "sla_breach_count"]
    shots = None
    for at in ("1999-01-01 00:00:00", AS_OF):
        shot = _health(t, at).select(*columns).withColumn("snapshot_date", instant(at))
        shots = shot if shots is None else shots.unionByName(shot)
    extract = serving.customer_extract(star.dim_customer(t), health.latest_snapshot(shots))
    return (
        extract.withColumn("snapshot_date", stamp(F.col("snapshot_date")))
        .withColumn("contract_value", F.col("contract_value").cast("double"))
    )


@query
def bi_sla_events(t: Tables) -> DataFrame:
    found = serving.incident_extract(star.fact_incident(t), star.dim_customer(t))
    return found.select(
        "incident_id", "incident_number", "customer_id", "customer_name", "severity", "status",
        "category", "subcategory", "sla_breached", stamp(F.col("occurred_at")).alias("occurred_at"),
        stamp(F.col("resolved_at")).alias("resolved_at"), "downtime_minutes",
        half_up(F.col("resolution_time_hours"), 4).alias("resolution_time_hours"),
        "root_cause", "affected_users_count",
    )


@query
def bi_sentiment(t: Tables) -> DataFrame:
    found = serving.sentiment_extract(_rollup(t))
    money = ["positive_pct", "neutral_pct", "negative_pct", "avg_sentiment_score"]
    days = ["period_start", "period_end"]
    return found.select(
        *[c for c in found.columns if c not in money + days],
        *[F.col(c).cast("double").alias(c) for c in money],
        *[F.col(c).cast("string").alias(c) for c in days],
    )


@query
def star_tickets(t: Tables) -> DataFrame:
    """Hours and breaches by region, tier and product category."""
    wide = serving.ticket_star(
        star.fact_ticket(t), star.dim_customer(t), star.dim_service(t), star.dim_product(t)
    )
    return wide.groupBy("region", "tier", "product_category", "severity").agg(
        F.count("*").alias("tickets"),
        F.count_if("sla_breached").alias("breaches"),
        F.sum(F.col("resolution_hours").cast("decimal(12,2)")).cast("double").alias("hours"),
        F.count_distinct("service_name").alias("services"),
    )


@query
def star_incidents(t: Tables) -> DataFrame:
    wide = serving.incident_star(star.fact_incident(t), star.dim_customer(t), star.dim_service(t))
    return wide.groupBy("region", "service_name", "severity").agg(
        F.count("*").alias("incidents"),
        F.sum(F.col("downtime_minutes").cast("decimal(12,2)")).cast("double").alias("downtime_minutes"),
        F.count_distinct("customer_name").alias("customers"),
    )


@query
def upsert_new_tickets(t: Tables) -> DataFrame:
    """Tickets of later years whose number no earlier ticket has, one per number."""
    rows = star.fact_ticket(t)
    border = instant("1998-01-01 00:00:00")
    old = rows.filter(F.col("created_at") < border)
    new = rows.filter(F.col("created_at") >= border)
    first = staging.first_per_key(new, "ticket_number", ["created_at", "ticket_id"])
    return staging.insert_absent(first, old, "ticket_number").select(
        "ticket_number", "ticket_id", "customer_id", stamp(F.col("created_at")).alias("created_at"), "severity"
    )


@query
def upsert_new_customers(t: Tables) -> DataFrame:
    """Customers to insert after resolving the names in the texts."""
    return _run(t).new_customers


def _review_actions(items: DataFrame) -> DataFrame:
    """Two reviewers act on the items: by the digits of the item id."""
    digit = F.substring("item_id", 1, 1)
    other = F.substring("item_id", 2, 1)
    first = items.filter(digit < "c").select(
        "item_id",
        F.when(digit < "4", "approved").when(digit < "8", "rejected").when(digit < "a", "ignored")
        .otherwise("vanished").alias("action"),
        instant("2024-02-01 08:00:00").alias("acted_at"),
        F.lit("ana").alias("reviewer"),
        F.concat(F.lit("note "), digit).alias("note"),
        F.lit(None).cast("string").alias("edited_value"),
    )
    second = items.filter(other < "3").select(
        "item_id",
        F.lit("edited").alias("action"),
        instant("2024-02-02 08:00:00").alias("acted_at"),
        F.lit("ben").alias("reviewer"),
        F.lit(None).cast("string").alias("note"),
        F.concat(F.lit("value "), other).alias("edited_value"),
    )
    return first.unionByName(second)


@query
def apply_review_actions(t: Tables) -> DataFrame:
    items = _pending_reviews(t)
    done = serving.apply_review_actions(items, _review_actions(items))
    return done.select(
        "item_id", "status", stamp(F.col("reviewed_at")).alias("reviewed_at"), "reviewed_by",
        "resolution_note", "edited_value",
    )


@query
def rejected_review_actions(t: Tables) -> DataFrame:
    items = _pending_reviews(t)
    _, refused = serving.split_actions(_review_actions(items), items)
    return refused.select("item_id", "action", "reason")


@query
def ack_insights(t: Tables) -> DataFrame:
    found = _health_insights(t)
    acks = found.filter(F.substring("insight_id", 1, 1) < "8").select(
        "insight_id", instant("2000-01-02 09:00:00").alias("acted_at"), F.lit("ana").alias("person")
    )
    return serving.acknowledge(found, acks).select(
        "insight_id", "entity_id", "status", stamp(F.col("acknowledged_at")).alias("acknowledged_at"), "acknowledged_by"
    )


# --- text functions ----------------------------------------------------------------------------------------


@query
def normalize_text(t: Tables) -> DataFrame:
    """Documents with tabs and CRLF put in, normalised again."""
    messy = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n\r\n \t\r")), F.lit(", "), F.lit(",\t "))
    return star.spread(t.documents).select("doc_id", tx.normalize_text(messy).alias("text"))


@query
def normalize_name(t: Tables) -> DataFrame:
    """Whole documents as names, with legal suffixes and punctuation."""
    raw = F.concat(F.col("text"), F.lit(" Co., LTD. "), F.col("source"), F.lit(" (Inc)"))
    return t.documents.select("doc_id", tx.normalize_name(raw).alias("name"))


@query
def normalize_date(t: Tables) -> DataFrame:
    """Order dates written in ten ways, or not as a date."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    shapes = ["yyyy-MM-dd", "d/M/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "dd MMM yyyy", "yyyy/MM/dd"]
    raw = F.lit("soon")
    for i, shape in enumerate(shapes):
        raw = F.when(key % 11 == i, F.date_format(day, shape)).otherwise(raw)
    return t.orders.select("o_orderkey", raw.alias("raw"), tx.normalize_date(raw).alias("iso"))


@query
def normalize_currency(t: Tables) -> DataFrame:
    key, cents = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    raw = (
        F.when(key % 7 == 0, F.concat(F.lit("$"), cents))
        .when(key % 7 == 1, F.concat(F.lit("€ "), cents))
        .when(key % 7 == 2, F.concat(cents, F.lit(" gbp")))
        .when(key % 7 == 3, F.concat(F.lit("£1,"), F.right(cents, F.lit(6))))
        .when(key % 7 == 4, F.concat(F.lit("CAD $"), cents))
        .when(key % 7 == 5, F.lit("n.a."))
        .otherwise(cents)
    )
    value = tx.normalize_currency(raw)
    return t.orders.select("o_orderkey", value.getField("amount").alias("amount"), value.getField("currency").alias("currency"))


@query
def normalize_severity(t: Tables) -> DataFrame:
    words = ["P1", " sev2 ", "Priority 3", "trivial", "URGENT", "High", "whatever", "normal", "blocker", "minor"]
    raw = texts.pick(words, F.col("o_orderkey"))
    level = tx.normalize_severity(raw)
    own = tx.normalize_severity(F.element_at(F.split("o_orderpriority", "-"), 2))
    return t.orders.groupBy(raw.alias("raw"), level.alias("level"), own.alias("own_level")).agg(F.count("*").alias("orders"))


@query
def expand_abbreviations(t: Tables) -> DataFrame:
    """Document heads with abbreviations between the words."""
    raw = F.concat_ws(" ", F.lit("the Db mgr of"), F.col("source"), F.lit("dept uses VPN and Api for"), F.col("text"), F.lit("inc"))
    return t.documents.select("doc_id", F.md5(tx.expand_abbreviations(raw)).alias("text_hash"), F.length(tx.expand_abbreviations(raw)).alias("n_chars"))


@query
def classify_issue(t: Tables) -> DataFrame:
    c = lexicon.issue_class(F.col("text"))
    return texts.ticket_texts(t).select("document_id", c.alias("c")).select("document_id", "c.category", "c.subcategory", "c.confidence")


@query
def sentiment(t: Tables) -> DataFrame:
    s = lexicon.sentiment(F.col("text"))
    return texts.ticket_texts(t).select("document_id", s.alias("s")).select("document_id", "s.label", "s.confidence", "s.score")


@query
def sentiment_documents(t: Tables) -> DataFrame:
    """The same rule over the given documents with another word list."""
    s = lexicon.sentiment(F.col("text"), CORPUS_POSITIVE, CORPUS_NEGATIVE)
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.label", "s.confidence", "s.score")


@query
def detect_severity(t: Tables) -> DataFrame:
    s = lexicon.severity(F.col("text"))
    return texts.ticket_texts(t).select("document_id", s.alias("s")).select("document_id", "s.level", "s.confidence")


@query
def topics_of_text(t: Tables) -> DataFrame:
    return texts.ticket_texts(t).select("document_id", joined(lexicon.topics(F.col("text")), ",").alias("topics"))


@query
def topics_of_documents(t: Tables) -> DataFrame:
    found = lexicon.topics(F.col("text"), CORPUS_TOPICS)
    return t.documents.select("doc_id", joined(found, ",").alias("topics"), lexicon.category(found).alias("category"))


@query
def classify_document(t: Tables) -> DataFrame:
    text = F.col("text")
    return texts.ticket_texts(t).select(
        "document_id",
        lexicon.category(lexicon.topics(text)).alias("category"),
        F.lit(0.78).alias("confidence"),
        lexicon.severity(text).getField("level").alias("severity"),
    )


@query
def extract_customer(t: Tables) -> DataFrame:
    return texts.ticket_texts(t).select("document_id", ex.customer_name(F.col("text")).alias("customer_name"))


@query
def extract_dates(t: Tables) -> DataFrame:
    return texts.ticket_texts(t).select("document_id", joined(ex.dates(F.col("text"))).alias("dates"))


@query
def extract_money(t: Tables) -> DataFrame:
    text = F.col("text")
    return texts.ticket_texts(t).select(
        "document_id",
        joined(ex.money(text)).alias("money"),
        joined(ex.money(text, strict=True)).alias("money_strict"),
    )


@query
def extract_contact(t: Tables) -> DataFrame:
    text = F.col("text")
    return texts.ticket_texts(t).select("document_id", ex.ticket_number(text).alias("ticket_number"), ex.email(text).alias("email"))


@query
def extract_email_documents(t: Tables) -> DataFrame:
    """First e-mail address of each given document, in any script."""
    return t.documents.select("doc_id", ex.email(F.col("text")).alias("email"))


@query
def extract_ops(t: Tables) -> DataFrame:
    text = F.col("text")
    return texts.ticket_texts(t).select("document_id", ex.incident_number(text).alias("incident_number"), ex.downtime_minutes(text).alias("downtime_minutes"))


@query
def extract_contract(t: Tables) -> DataFrame:
    return texts.ticket_texts(t).select("document_id", ex.contract_number(F.col("text")).alias("contract_number"))


@query
def key_phrases(t: Tables) -> DataFrame:
    return texts.ticket_texts(t).select("document_id", joined(ex.key_phrases(F.col("text"))).alias("key_phrases"))


@query
def extract_summary(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ex.summary(F.col("text")).alias("summary"), tx.word_count(F.col("text")).alias("words"))


@query
def insight_narrative(t: Tables) -> DataFrame:
    """One sentence per customer about the change of its tickets."""
    found = _health(t)
    line = ins.narrative(F.lit("Ticket Volume Change"), F.col("name"), F.lit("ticket count"), F.col("ticket_change_pct"))
    return found.select("customer_id", line.alias("narrative"))


# --- staging and facts -----------------------------------------------------------------------------------------


@query
def extract_fields(t: Tables) -> DataFrame:
    """Extraction result per document: fields, confidence and summary."""
    return _extracted(t).select(
        "document_id",
        joined(F.transform("fields", lambda f: F.concat_ws("=", f.field, F.coalesce(f.value, F.lit("")), f.confidence.cast("string")))).alias("fields"),
        joined(F.transform("entities", lambda e: F.concat_ws("=", e.type, e.value))).alias("entities"),
        "overall_confidence",
        "summary",
    )


@query
def staged_entities(t: Tables) -> DataFrame:
    return staging.staged_entities(_extracted(t))


@query
def review_items(t: Tables) -> DataFrame:
    """Low-confidence fields and ambiguous names of a run."""
    return _run(t).reviews


@query
def ticket_facts(t: Tables) -> DataFrame:
    found = _run(t).tickets
    return found.withColumn("tags", joined(F.col("tags"), ",")).withColumn("arrived_at", stamp(F.col("arrived_at")))


@query
def incident_facts(t: Tables) -> DataFrame:
    found = staging.incident_facts(_extracted(t))
    return found.withColumn("arrived_at", stamp(F.col("arrived_at")))


@query
def contract_facts(t: Tables) -> DataFrame:
    found = _run(t).contracts
    return found.withColumn("arrived_at", stamp(F.col("arrived_at")))


@query
def feedback_facts(t: Tables) -> DataFrame:
    found = _run(t).feedback
    return found.withColumn("topics", joined(F.col("topics"), ",")).withColumn("key_phrases", joined(F.col("key_phrases"), ","))


@query
def labelled_feedback(t: Tables) -> DataFrame:
    """Labelled documents as feedback: counts and text volume per source and sentiment."""
    return star.fact_feedback(t).groupBy("feedback_type", "sentiment").agg(
        F.count("*").alias("records"), F.sum(F.length("raw_text")).alias("n_chars")
    )


@query
def run_summary(t: Tables) -> DataFrame:
    return staging.run_summary(_extracted(t))


@query
def provenance_links(t: Tables) -> DataFrame:
    extracted = _extracted(t)
    facts = staging.incident_facts(extracted)
    return staging.provenance_links(staging.staged_entities(extracted), facts, "fact_incident", "incident_number")


# --- entity resolution ---------------------------------------------------------------------------------------------


@query
def resolve_exact(t: Tables) -> DataFrame:
    return resolve.resolve_exact(_service_names(t), texts.service_registry(t))


@query
def resolve_normalized(t: Tables) -> DataFrame:
    registry = texts.service_registry(t)
    names = _service_names(t)
    rest = names.join(resolve.resolve_exact(names, registry), ["entity_type", "raw_value"], "left_anti")
    return resolve.resolve_normalized(rest, resolve.name_table(registry))


@query
def resolve_fuzzy_lev(t: Tables) -> DataFrame:
    """Best partner of every distinct normalised name by edit similarity."""
    norms = _service_names(t).select("entity_type", tx.normalize_name(F.col("raw_value")).alias("norm"))
    known = cut_lineage(resolve.name_table(texts.service_registry(t)))
    return resolve.best_fuzzy(norms, known, "levenshtein")


@query
def resolve_fuzzy(t: Tables) -> DataFrame:
    """Best partner by common-subsequence similarity."""
    norms = _service_names(t).select("entity_type", tx.normalize_name(F.col("raw_value")).alias("norm"))
    return resolve.best_fuzzy(norms, cut_lineage(resolve.name_table(texts.service_registry(t))))


@query
def resolve_new(t: Tables) -> DataFrame:
    decisions = resolve.resolve_names(_service_names(t), texts.service_registry(t))
    return resolve.new_entities(decisions)


@query
def resolve_all(t: Tables) -> DataFrame:
    return resolve.resolve_names(_service_names(t), texts.service_registry(t))


@query
def resolve_components(t: Tables) -> DataFrame:
    """All decisions when new names that are alike, directly or over others, are one entity."""
    return resolve.resolve_names(_service_names(t), texts.service_registry(t), link=COMPONENT_LINK)


@query
def registry_after_run(t: Tables) -> DataFrame:
    """The stored registry after two runs: the mentions of the first half of the orders, then the others."""
    path = scratch_path(t.spark, "registry")
    registry.create(texts.service_registry(t), path)
    mentions = texts.service_mentions(t)
    half = t.orders.agg((F.max("o_orderkey") / 2).alias("half"))
    for first in (True, False):
        run = mentions.join(half, (F.col("seen_order") <= F.col("half")) == F.lit(first), "left_semi")
        names = resolve.distinct_names(run, "seen_order")
        registry.merge(cut_lineage(resolve.resolve_names(names, registry.read(t.spark, path))), path)
    stored = registry.read(t.spark, path)
    return stored.select("entity_type", "canonical_id", "name", F.array_join("aliases", "|").alias("aliases"))


@query
def resolution_log(t: Tables) -> DataFrame:
    """Decision of every mention in the operational texts."""
    return _run(t).log.select(
        "document_id", "entity_type", "raw_value", "canonical_id", "canonical_name",
        "resolution_method", "confidence", "is_new_entity", "requires_review", "score",
    )


@query
def customer_aliases(t: Tables) -> DataFrame:
    return resolve.aliases(_run(t).decisions)


# --- scoring ------------------------------------------------------------------------------------------------------------


@query
def trend(t: Tables) -> DataFrame:
    return series.trend(_hourly(t), ["event_type"], _month_chunk())


@query
def trend_services(t: Tables) -> DataFrame:
    """Monthly ticket hours of every service."""
    months = series.metric_series(star.fact_ticket(t), ["service_id"], "created_at", "resolution_hours", "month")
    return series.trend(months, ["service_id"], F.date_trunc("year", "t"))


@query
def anomaly_zscore(t: Tables) -> DataFrame:
    found = series.zscore_anomalies(_hourly(t), ["event_type"])
    return found.withColumn("t", stamp(F.col("t")))


@query
def anomaly_iqr(t: Tables) -> DataFrame:
    found = series.iqr_anomalies(_hourly(t), ["event_type"])
    return found.withColumn("t", stamp(F.col("t")))


@query
def anomaly_iqr_prices(t: Tables) -> DataFrame:
    """Order lines whose price is outside the fences of their return flag."""
    lines = t.lineitem.select(
        F.col("l_returnflag"), "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").alias("value"),
    )
    return series.iqr_anomalies(lines, ["l_returnflag"], k=0.5)


@query
def anomaly_rolling(t: Tables) -> DataFrame:
    found = series.rolling_anomalies(_hourly(t), ["event_type"], _month_chunk(), block=100)
    return found.withColumn("t", stamp(F.col("t")))


@query
def customer_health(t: Tables) -> DataFrame:
    return _health(t).select(
        "customer_id", "health_score", "risk_level", "trend", "ticket_frequency", "sentiment",
        "sla_compliance", "resolution_time", "incident_frequency", "customer_rating",
        "ticket_change_pct", "revenue_at_risk",
    )


@query
def topic_counts(t: Tables) -> DataFrame:
    return _counts(t)


@query
def topic_counts_unbounded(t: Tables) -> DataFrame:
    """Everything before the recent period counts as earlier."""
    return topics.topic_counts(star.event_topics(t), instant(TOPICS_AS_OF), TOPIC_DAYS)


@query
def emerging_topics(t: Tables) -> DataFrame:
    return topics.emerging_topics(_counts(t))


@query
def emerging_topics_joined(t: Tables) -> DataFrame:
    """The same from two separate histograms."""
    border, start = instant("2024-01-24 00:00:00"), instant("2024-01-17 00:00:00")
    at = F.col("created_at")
    mentions = star.event_topics(t)
    now = mentions.filter(at >= border).groupBy("topic").count()
    before = mentions.filter((at >= start) & (at < border)).groupBy("topic").count()
    return topics.emerging_topics(topics.pair_counts(now, before))


@query
def root_causes(t: Tables) -> DataFrame:
    return _causes(t)


@query
def root_causes_recent(t: Tables) -> DataFrame:
    """Hypotheses from the last 90 days only."""
    return causes.root_causes(star.fact_incident(t), as_of=instant(AS_OF), window_days=90)


@query
def downtime_impact(t: Tables) -> DataFrame:
    rate = F.when(F.col("customer_id") % 3 == 0, 20000.0).when(F.col("customer_id") % 3 == 1, 0.0)
    loss = impact.downtime_impact(F.col("downtime_minutes"), F.col("affected_users_count"), rate)
    return star.incident_events(t).select("incident_id", loss.alias("x")).select("incident_id", "x.*")


@query
def sla_penalty(t: Tables) -> DataFrame:
    breaches = star.fact_ticket(t).groupBy("customer_id").agg(F.count_if("sla_breached").alias("breach_count"))
    rows = star.dim_customer(t).select("customer_id", "contract_value").join(breaches, "customer_id")
    cost = impact.sla_penalty(F.col("breach_count"), F.col("contract_value").cast("double"))
    return rows.select("customer_id", "breach_count", cost.alias("x")).select("customer_id", "breach_count", "x.*")


@query
def insight_priority(t: Tables) -> DataFrame:
    """The priority rule over every combination the customers give."""
    kinds = ["risk", "anomaly", "sla_risk", "emerging_issue", "customer_issue", "root_cause", "trend", "data_quality", "opportunity", "recommendation", "other"]
    rows = _scored(t)
    kind = texts.pick(kinds, F.col("customer_id"))
    score = impact.priority_score(
        F.col("risk_level"), F.col("churn_risk_score"), kind, F.col("ticket_count"), F.col("revenue_at_risk")
    )
    return rows.select("customer_id", kind.alias("insight_type"), score.alias("priority_score"))


# --- insights ------------------------------------------------------------------------------------------------------------------


def _flat(insights: DataFrame) -> DataFrame:
    entry = lambda e: F.concat(e.label, F.lit("="), e.value, F.lit("="), e.source_type)
    return insights.select(
        *[c for c in insights.columns if c not in ("evidence", "contributing_factors", "created_at")],
        joined(F.transform("evidence", entry)).alias("evidence"),
        joined(F.col("contributing_factors")).alias("contributing_factors"),
        stamp(F.col("created_at")).alias("created_at"),
    )


@query
def insights_health(t: Tables) -> DataFrame:
    return _flat(_health_insights(t))


@query
def insights_emerging(t: Tables) -> DataFrame:
    found = topics.emerging_topics(_counts(t))
    return _flat(ins.emerging_insights(found, instant(TOPICS_AS_OF), k=None))


@query
def insights_sla_risk(t: Tables) -> DataFrame:
    """Open tickets by used share of their time."""
    names = star.dim_customer(t).select("customer_id", F.col("name").alias("customer_name"))
    rows = (
        star.fact_ticket(t)
        .filter(F.col("status") == "open")
        .join(names, "customer_id", "left")
        .withColumn("elapsed_hours", F.col("resolution_hours"))
        .withColumn("breach_probability", ins.elapsed_share(F.col("elapsed_hours"), F.col("sla_hours")))
    )
    return _flat(ins.sla_risk_insights(rows, instant(AS_OF)))


@query
def insights_root_cause(t: Tables) -> DataFrame:
    return _flat(ins.root_cause_insights(_causes(t), instant(AS_OF), k=None))


@query
def insights_full(t: Tables) -> DataFrame:
    found = full_analysis(
        star.dim_customer(t), star.fact_ticket(t), star.fact_incident(t), star.event_topics(t),
        instant(AS_OF), instant(TOPICS_AS_OF), WINDOW_DAYS, TOPIC_DAYS, TOPIC_DAYS,
    )
    return _flat(found)


# --- data quality ---------------------------------------------------------------------------------------------------------------------


@query
def dq_completeness(t: Tables) -> DataFrame:
    return quality.missing_by_field(texts.dirty_tickets(t).drop("row_id"), "ticket")


@query
def dq_validity(t: Tables) -> DataFrame:
    counts = quality.row_counts(texts.dirty_tickets(t).drop("row_id"), "ticket", instant(AS_OF))
    return counts.select("total_records", "invalid_values", "invalid_records")


@query
def dq_uniqueness(t: Tables) -> DataFrame:
    return quality.duplicate_count(texts.dirty_tickets(t).drop("row_id"))


@query
def dq_consistency(t: Tables) -> DataFrame:
    counts = quality.row_counts(texts.dirty_tickets(t).drop("row_id"), "ticket", instant(AS_OF))
    return counts.select("total_records", "order_errors")


@query
def dq_timeliness(t: Tables) -> DataFrame:
    counts = quality.row_counts(texts.dirty_tickets(t).drop("row_id"), "ticket", instant(AS_OF))
    return counts.select("total_records", "stale_records")


def _reports(t: Tables) -> DataFrame:
    at = instant(AS_OF)
    dirty = texts.dirty_tickets(t).drop("row_id")
    customers = profile.as_strings(
        t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("c"), "c_custkey", F.lit("@example.org"))).alias("email"))
    )
    return quality.quality_report(dirty, "tickets", "ticket", at).unionByName(
        quality.quality_report(customers, "customers", "customer", at)
    )


@query
def dq_report(t: Tables) -> DataFrame:
    return _reports(t).withColumn("report_date", stamp(F.col("report_date")))


@query
def dq_documents(t: Tables) -> DataFrame:
    """A report per document, its record type by its domain."""
    found = quality.document_reports(texts.document_records(t), instant(AS_OF))
    return found.withColumn("report_date", stamp(F.col("report_date")))


@query
def dq_summary(t: Tables) -> DataFrame:
    return quality.quality_summary(_reports(t))


@query
def dq_issues(t: Tables) -> DataFrame:
    return quality.quality_issues(texts.dirty_tickets(t), "ticket", "row_id")


@query
def dq_field_stats(t: Tables) -> DataFrame:
    return quality.field_stats(texts.dirty_tickets(t).drop("row_id"))


# --- streams ------------------------------------------------------------------------------------------------------------------------------


def _stream(t: Tables, table: str) -> DataFrame:
    schema = getattr(t, table).schema
    return jobs.read_new_table(t.spark, t.folder, table, schema)


def _finish(query_) -> None:
    query_.awaitTermination()


@query
def event_topic_windows(t: Tables) -> DataFrame:
    """Topic mentions in sliding windows, as a batch."""
    found = jobs.topic_windows(star.event_topics(t))
    return found.withColumn("window_start", stamp(F.col("window_start"))).withColumn("window_end", stamp(F.col("window_end")))


@query
def stream_topic_windows(t: Tables) -> DataFrame:
    """Closed seven-day windows given out by a stream over the events."""
    live = Tables(t.spark, t.folder)
    live.events = _stream(t, "events")
    found = jobs.topic_window_stream(star.event_topics(live), "1 day", "7 days", "1 day")
    target, checkpoint = scratch_path(t.spark, "windows"), scratch_path(t.spark, "windows-state")
    _finish(jobs.to_files(found, target, checkpoint))
    back = t.spark.read.schema(found.schema).parquet(target)
    return back.withColumn("window_start", stamp(F.col("window_start"))).withColumn("window_end", stamp(F.col("window_end")))


def _arriving(docs: DataFrame) -> DataFrame:
    """Documents a minute apart, every third one a day and a half late."""
    at = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), instant("2024-01-01 00:00:00"))
    late = F.when(F.col("doc_id") % 3 == 0, F.timestamp_add("HOUR", F.lit(-36), at)).otherwise(at)
    return jobs.hashed(docs, "text").withColumn("arrived_at", late)


@query
def stream_dedup_by_hash(t: Tables) -> DataFrame:
    """Distinct contents of a stream of documents, each stored by the batch that brought it first."""
    docs = jobs.hashed(_stream(t, "documents"), "text").select("content_hash")
    target, checkpoint = scratch_path(t.spark, "contents"), scratch_path(t.spark, "contents-state")
    _finish(jobs.load_new(docs, target, checkpoint, "content_hash", lambda batch: batch.distinct()))
    return jobs.loaded(t.spark, target)


@query
def stream_intake(t: Tables) -> DataFrame:
    """First document and copies of every content of a stream whose documents come out of order."""
    target, checkpoint = scratch_path(t.spark, "intake"), scratch_path(t.spark, "intake-state")
    _finish(jobs.intake(_arriving(_stream(t, "documents")), target, checkpoint, "doc_id", "arrived_at"))
    return jobs.intake_state(t.spark, target).withColumn("arrived_at", stamp(F.col("arrived_at")))


@query
def stream_incident_facts(t: Tables) -> DataFrame:
    """Incident facts loaded by a stream of operational texts."""
    live = Tables(t.spark, t.folder)
    live.orders = _stream(t, "orders")
    target, checkpoint = scratch_path(t.spark, "incidents"), scratch_path(t.spark, "incidents-state")
    build = lambda batch: staging.incident_facts(staging.extract(batch))
    _finish(jobs.load_new(texts.ticket_texts(live), target, checkpoint, "incident_number", build))
    return jobs.loaded(t.spark, target).withColumn("arrived_at", stamp(F.col("arrived_at")))


@query
def stream_metric_anomalies(t: Tables) -> DataFrame:
    """Closed hours of an event stream against the moments of the stored history."""
    hours = jobs.hourly_metrics(_stream(t, "events"), "1 hour")
    target, checkpoint = scratch_path(t.spark, "anomalies"), scratch_path(t.spark, "anomalies-state")
    _finish(jobs.metric_anomalies(hours, _hourly(t), target, checkpoint, ["event_type"]))
    return t.spark.read.parquet(target).drop("batch_id").withColumn("t", stamp(F.col("t")))


@query
def stream_learnt_moments(t: Tables) -> DataFrame:
    """Count, mean and deviation of every metric as learnt batch by batch from its closed hours."""
    hours = jobs.hourly_metrics(_stream(t, "events"), "1 hour")
    target, checkpoint = scratch_path(t.spark, "learnt"), scratch_path(t.spark, "learnt-state")
    _finish(jobs.metric_anomalies(hours, None, target, checkpoint, ["event_type"], learn=True))
    learnt = series.stats_of(jobs.learnt_moments(t.spark, target))
    return learnt.select(
        "event_type", F.col("_n").alias("hours"), half_up(F.col("_mean"), 4).alias("mean"), half_up(F.col("_sd"), 4).alias("deviation")
    )


def flagship(t: Tables) -> DataFrame:
    """Which customers are at risk, and what is at stake?"""
    return top_risk_customers(t)


def build(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query as a function of session and folder."""
    return lambda spark, folder: CATALOG[name](Tables(spark, folder))
