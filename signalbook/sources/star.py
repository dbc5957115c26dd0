"""Star schema of customers, services, products, tickets, incidents and feedback.

Derived from the order tables.  Fact builders only join what their own columns
need, so a caller that counts tickets never reads parts or names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.text import normalize_severity
from signalbook.functions.values import money, stable_id

SLA_HOURS = {"URGENT": 24, "HIGH": 36, "MEDIUM": 42}
SLA_HOURS_OTHER = 48
OPEN_SINCE = "2001-06-01"


class Tables:
    """Lazy access to the raw tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


#: Session setting: tasks to which tables are dealt out before costly row work.
SPREAD_SETTING = "signalbook.spread.partitions"


def spread(df: DataFrame, costly: bool = False) -> DataFrame:
    """The rows dealt out anew if the session asks for it: a file of one row group is one task.

    With ``costly`` row work they always are, unset to as many tasks as a shuffle or the cores ask for.
    """
    spark = df.sparkSession
    parts = spark.conf.get(SPREAD_SETTING, None)
    if not parts and costly:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(int(parts)) if parts and not df.isStreaming else df


def word(seed: Column, start: int = 1, length: int = 8) -> Column:
    """A made-up capitalised name of letters a-p, fixed by the seed."""
    letters = F.translate(F.substring(F.md5(seed), start, length), "0123456789", "ghijklmnop")
    return F.initcap(letters)


def company_name(custkey: Column) -> Column:
    seed = custkey.cast("string")
    return F.concat_ws(" ", word(seed), word(seed, 9))


def padded(prefix: str, key: Column, width: int = 9) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def dim_customer(t: Tables) -> DataFrame:
    """Customers with region, tier and the sum of their order values."""
    value = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.sum(money(F.col("o_totalprice"))).alias("contract_value"),
        F.min("o_orderdate").alias("since"),
    )
    balance = F.col("c_acctbal")
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            padded("CUST_", F.col("c_custkey")).alias("canonical_id"),
            F.col("c_name").alias("name"),
            company_name(F.col("c_custkey")).alias("company"),
            F.col("c_mktsegment").alias("industry"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            F.when(balance >= 7500, "enterprise")
            .when(balance >= 2500, "business")
            .otherwise("standard")
            .alias("tier"),
            (balance >= 0).alias("is_active"),
        )
        .join(value, "customer_id", "left")
    )


def dim_service(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("service_id"), F.col("s_name").alias("name"))


def dim_product(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.col("p_brand").alias("product_subcategory"),
    )


def _line_id() -> Column:
    """All columns of a line: order and line number alone are not unique."""
    numbers = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    amounts = [
        F.col(c).cast("decimal(14,2)").cast("string")
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ]
    rest = [F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd")]
    return stable_id(*numbers, *amounts, *rest)


def _line_number(prefix: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), F.col("l_orderkey"), F.col("l_linenumber"))


def fact_ticket(t: Tables) -> DataFrame:
    """One ticket per order line: hours taken against the target of its priority."""
    urgency = F.element_at(F.split("o_orderpriority", "-"), 2)
    target = F.lit(SLA_HOURS_OTHER)
    for name, hours in SLA_HOURS.items():
        target = F.when(urgency == name, hours).otherwise(target)
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _line_id().alias("ticket_id"),
            _line_number("TK").alias("ticket_number"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_suppkey").alias("service_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("o_orderdate").alias("created_at"),
            normalize_severity(urgency).alias("severity"),
            F.when(F.col("o_orderstatus") == "F", "closed")
            .when(F.col("o_orderstatus") == "O", "open")
            .otherwise("in_progress")
            .alias("status"),
            F.col("l_quantity").alias("resolution_hours"),
            target.cast("double").alias("sla_hours"),
            (F.col("l_quantity") > target).alias("sla_breached"),
            F.when(F.col("l_returnflag") == "R", "negative")
            .when(F.col("l_returnflag") == "A", "neutral")
            .otherwise("positive")
            .alias("sentiment"),
            F.when(F.col("l_returnflag") == "R", 0.2)
            .when(F.col("l_returnflag") == "A", 0.5)
            .otherwise(0.8)
            .alias("sentiment_score"),
        )
    )


def _incident_lines(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))


def incident_events(t: Tables) -> DataFrame:
    """Incidents with customer, service, time and severity, without descriptions."""
    minutes = F.col("l_quantity")
    happened = F.col("l_shipdate")
    is_open = happened >= F.lit(OPEN_SINCE).cast("timestamp_ntz")
    end = F.timestamp_add("MINUTE", minutes.cast("int"), happened)
    return (
        _incident_lines(t)
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _line_id().alias("incident_id"),
            _line_number("INC").alias("incident_number"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_suppkey").alias("service_id"),
            F.col("l_partkey").alias("product_id"),
            F.when(minutes > 40, "P1").when(minutes > 25, "P2").when(minutes > 10, "P3")
            .otherwise("P4").alias("severity"),
            F.when(is_open, "open").otherwise("resolved").alias("status"),
            happened.alias("occurred_at"),
            F.when(~is_open, end).alias("resolved_at"),
            minutes.alias("downtime_minutes"),
            F.when(~is_open, minutes / 60).alias("resolution_time_hours"),
            (minutes > 36).alias("sla_breached"),
            (F.col("l_linenumber") * 100).alias("affected_users_count"),
        )
    )


def fact_incident(t: Tables) -> DataFrame:
    """Incidents with category and root cause from the part concerned."""
    return (
        incident_events(t)
        .join(dim_product(t), "product_id", "left")
        .withColumnsRenamed(
            {
                "product_name": "root_cause",
                "product_category": "category",
                "product_subcategory": "subcategory",
            }
        )
    )


def fact_feedback(t: Tables) -> DataFrame:
    """Labelled documents as feedback."""
    return t.labels.join(t.documents, "doc_id").select(
        F.col("doc_id").alias("feedback_id"),
        F.col("source").alias("feedback_type"),
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neutral")
        .alias("sentiment"),
        F.col("text").alias("raw_text"),
    )


def event_topics(t: Tables) -> DataFrame:
    """Topic mentions: event type and the key in its properties."""
    key = F.get_json_object("props", "$.k")
    return t.events.select(
        F.concat_ws(":", "event_type", key).alias("topic"), F.col("ts").alias("created_at")
    )


def raw_documents(t: Tables) -> DataFrame:
    """Documents as uploads with a processing status."""
    return t.documents.select(
        F.concat(F.lit("DOC-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("document_id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"),
        F.col("lang").alias("domain"),
        F.octet_length("text").alias("file_size_bytes"),
        F.element_at(
            F.array(F.lit("completed"), F.lit("completed"), F.lit("processing"), F.lit("failed")),
            (F.col("doc_id") % 4 + 1).cast("int"),
        ).alias("status"),
        F.timestamp_add(
            "MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        ).alias("created_at"),
        F.col("text"),
    )
