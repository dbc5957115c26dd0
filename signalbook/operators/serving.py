"""Lists, KPIs, rollups, extracts and keyed updates over the star schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from signalbook import fixed_values as fv
from signalbook.functions.values import days_before, half_up, money
from signalbook.operators.shape import join_keys, side_by_side
from signalbook.session import cut_lineage

AT_RISK = ["HIGH", "CRITICAL"]


# --- filters and pages ------------------------------------------------------------


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters; an argument that is None does not filter."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def name_contains(df: DataFrame, part: str, column: str = "name", literal: bool = False) -> DataFrame:
    """Case-insensitive search; % and _ are wildcards unless ``literal``."""
    if literal:
        return df.filter(F.contains(F.lower(column), F.lit(part.lower())))
    return df.filter(F.col(column).ilike(f"%{part}%"))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a sorted list with the size of the whole list.

    The order should end with a unique column.  Sorting keeps only the rows up
    to the page in each task.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def page_after(df: DataFrame, order: str, key: str, last: tuple, size: int = 20) -> DataFrame:
    """The next page after a known last row, for deep paging in descending order.

    Rows without a sort value come after all others, so a last row of (None, key) goes on among them.
    """
    row = F.lit(last[1])
    if last[0] is None:
        later = F.col(order).isNull() & (F.col(key) > row)
    else:
        at = F.lit(last[0])
        later = (F.col(order) < at) | ((F.col(order) == at) & (F.col(key) > row)) | F.col(order).isNull()
    return df.filter(later).orderBy(F.desc_nulls_last(order), F.asc(key)).limit(size)


#: Bits of monotonically_increasing_id that count inside a partition.
_PLACE_BITS = 33


def store_pages(df: DataFrame, order: Sequence[Column], path: str) -> None:
    """Store a list in ranges of its order, with an index of how many rows each range has.

    The order should end with a unique column.  The list is computed and sorted once; see :func:`page_at`.
    """
    place = F.monotonically_increasing_id()
    df.limit(0).write.parquet(f"{path}/columns")  # an empty list has no ranges to read them from
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.shiftright(place, _PLACE_BITS).cast("int"))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .write.partitionBy("_range")
        .parquet(f"{path}/rows")
    )
    stored = df.sparkSession.read.schema("_place long, _range int").parquet(f"{path}/rows")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as ranges, which is a setting: one task orders them.
    stored.groupBy("_range").agg(F.count("_place").alias("rows")).withColumn(
        "start", F.coalesce(F.sum("rows").over(before), F.lit(0))
    ).coalesce(1).write.parquet(f"{path}/index")


def page_at(spark: SparkSession, path: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of a stored list, however deep, and the size of the whole list.

    Reads the index and the ranges that the page lies in (one, or two where it crosses a border), and
    of these only the rows of the page; the total comes from the index.
    """
    first = (number - 1) * size
    index = spark.read.parquet(f"{path}/index")
    total = index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = index.where((F.col("start") < first + size) & (F.col("start") + F.col("rows") > first)).orderBy("start").collect()
    columns = spark.read.parquet(f"{path}/columns").schema
    schema = StructType([*columns, StructField("_place", LongType()), StructField("_range", IntegerType())])
    found = [
        spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows/_range={r['_range']}")
        .where(F.col("_place").between(first - r["start"], first + size - 1 - r["start"]))
        for r in met
    ]
    rows = reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema))
    return rows.orderBy("_range", "_place").drop("_range", "_place").withColumn("total", F.lit(total))


# --- KPIs ---------------------------------------------------------------------------


def kpi_overview(
    customers: DataFrame, tickets: DataFrame, incidents: DataFrame, insights: DataFrame
) -> DataFrame:
    """Eight counts from scored customers, tickets and incidents counted per customer, and insights."""
    status = F.col("status")
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    return side_by_side(
        customers.agg(
            F.count("*").alias("total_customers"),
            F.count_if(F.col("risk_level").isin(AT_RISK)).alias("high_risk_customers"),
        ),
        tickets.agg(
            total("total").alias("total_tickets"),
            total("open").alias("open_tickets"),
        ),
        incidents.agg(
            total("total").alias("total_incidents"),
            total("open").alias("open_incidents"),
            total("breached").alias("sla_breaches"),
        ),
        insights.agg(
            F.count_if((F.col("severity") == "CRITICAL") & (status == "active")).alias(
                "critical_insights"
            )
        ),
    )


def overview_counts(
    customers: DataFrame, tickets: DataFrame, incidents: DataFrame, insights: DataFrame
) -> DataFrame:
    """Four counts; tickets and incidents are counted per customer."""
    return side_by_side(
        customers.agg(F.count("*").alias("customers")),
        tickets.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("tickets")),
        incidents.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("incidents")),
        insights.agg(F.count_if(F.col("status") == "active").alias("active_insights")),
    )


def activity_overview(rows: DataFrame, notable: Column) -> DataFrame:
    """The counts of :func:`kpi_overview` and active_insights in one aggregate.

    ``rows`` are scored rows of :func:`~signalbook.operators.health.whole_activity`; ``notable`` tells
    which customers get an insight.  Same values as from separate frames, but each table is read once.
    """
    known, level = F.col("is_customer"), F.col("risk_level")
    total = lambda column, name: F.coalesce(F.sum(column), F.lit(0)).alias(name)
    return rows.agg(
        F.count_if(known).alias("total_customers"),
        F.count_if(known & level.isin(AT_RISK)).alias("high_risk_customers"),
        total("tickets", "total_tickets"),
        total("tickets_open", "open_tickets"),
        total("incidents", "total_incidents"),
        total("incidents_open", "open_incidents"),
        total("incidents_breached", "sla_breaches"),
        F.count_if(known & notable & (level == "CRITICAL")).alias("critical_insights"),
        F.count_if(known & notable).alias("active_insights"),
    )


def health_distribution(customers: DataFrame) -> DataFrame:
    level = F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level")
    return customers.groupBy(level).agg(F.count("*").alias("count"))


def customers_by_risk(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("risk_level")
        .agg(F.count_distinct("customer_id").alias("customers"))
        .orderBy(F.desc("customers"), "risk_level")
    )


def breach_matrix(incidents: DataFrame) -> DataFrame:
    """Distinct incidents per severity, breached and not, in severity order."""
    return (
        incidents.groupBy("severity")
        .agg(
            F.count_distinct(F.when(F.col("sla_breached"), F.col("incident_id"))).alias("breached"),
            F.count_distinct(F.when(~F.col("sla_breached"), F.col("incident_id"))).alias(
                "not_breached"
            ),
        )
        .orderBy("severity")
    )


def churn_matrix(customers: DataFrame) -> DataFrame:
    """Per customer name and risk: contract value, average health and churn risk."""
    return customers.groupBy("name", "risk_level").agg(
        F.sum(money(F.col("contract_value"))).cast("double").alias("contract_value"),
        half_up(F.sum(money(F.col("contract_value"))).cast("double") / 1000, 4).alias("contract_value_k"),
        half_up(F.avg("health_score"), 4).alias("avg_health"),
        half_up(F.avg("churn_risk_score"), 4).alias("avg_churn_risk"),
    )


def complete_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """How many rows have every required column."""
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(full).alias("complete_rows"))


# --- canned reports -------------------------------------------------------------------


def top_risk_customers(customers: DataFrame, k: int = 10) -> DataFrame:
    """Lowest health first among customers at high or critical risk."""
    return (
        customers.filter(F.col("risk_level").isin(AT_RISK))
        .orderBy("health_score", "canonical_id")
        .limit(k)
    )


def recent_incidents(incidents: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    at = F.col("occurred_at")
    return (
        incidents.filter(at >= days_before(as_of, days))
        .groupBy("severity")
        .agg(F.count("*").alias("count"))
    )


def negative_services(rollup: DataFrame, k: int = 10) -> DataFrame:
    """Service periods with the largest share of negative records."""
    return (
        rollup.filter(F.col("service_id").isNotNull())
        .orderBy(F.desc("negative_pct"), "service_id", "period_start")
        .limit(k)
    )


def breach_and_sentiment(tickets: DataFrame) -> DataFrame:
    """Customers with at least one breach and at least one negative ticket."""
    return (
        tickets.groupBy("customer_id")
        .agg(
            F.count_if("sla_breached").alias("breaches"),
            F.count_if(F.col("sentiment") == "negative").alias("negative_tickets"),
            F.count("*").alias("tickets"),
        )
        .filter((F.col("breaches") > 0) & (F.col("negative_tickets") > 0))
    )


def latest_months(rollup: DataFrame, k: int = 12) -> DataFrame:
    """The newest periods of the overall rows, oldest first."""
    newest = rollup.filter(F.col("scope") == "all").orderBy(F.desc("period_start")).limit(k)
    return newest.select(
        F.date_format("period_start", "yyyy-MM").alias("period"),
        "positive_pct",
        "neutral_pct",
        "negative_pct",
        "total_records",
    ).orderBy("period")


# --- rollups ---------------------------------------------------------------------------

SCOPES = ["customer_id", "service_id", "product_id", "category"]


def _scope(scopes: Sequence[str]) -> Column:
    """The dimension that a grouped row is about, by the _no_ columns of the grouping sets."""
    scope = F.lit("all")
    for s in scopes:
        scope = F.when(F.col(f"_no_{s}") == 0, s).otherwise(scope)
    return scope


def sentiment_rollup(
    records: DataFrame, time: str = "created_at", every: str = "month", scopes: Sequence[str] = SCOPES
) -> DataFrame:
    """Sentiment per period, overall and per dimension.

    The few columns asked for are stored once, and every dimension is an aggregate of its own over
    them: a task holds the groups of one dimension only, and none of the joins behind the records.
    ``scope`` names the dimension of a row, so an aggregate row is never confused with a missing value.
    """
    period = F.col("period_start")
    rows = records.select(
        F.date_trunc(every, time).cast("timestamp_ntz").alias("period_start"),
        *scopes,
        "sentiment",
        "sentiment_score",
    )
    if scopes:
        rows = cut_lineage(rows)
    total = F.col("total_records")
    mood = F.col("sentiment")
    counts = [
        F.count("*").alias("total_records"),
        F.count_if(mood == "positive").alias("positive_count"),
        F.count_if(mood == "neutral").alias("neutral_count"),
        F.count_if(mood == "negative").alias("negative_count"),
        F.sum(F.col("sentiment_score").cast("decimal(10,4)")).alias("_score"),
    ]

    def per(scope: str | None) -> DataFrame:
        found = rows.groupBy(period, *([F.col(scope)] if scope else [])).agg(*counts)
        dims = [F.col(s) if s == scope else F.lit(None).cast(rows.schema[s].dataType).alias(s) for s in scopes]
        return found.select(period, F.lit(scope or "all").alias("scope"), *dims, *[c for c in found.columns if c not in ("period_start", scope)])

    rolled = reduce(DataFrame.unionByName, [per(s) for s in (None, *scopes)])
    share = lambda c: half_up(F.col(c) * 100.0 / total, 2)
    step = {
        "day": F.make_dt_interval(days=F.lit(1)),
        "week": F.make_dt_interval(days=F.lit(7)),
        "month": F.make_ym_interval(months=F.lit(1)),
    }[every]
    return rolled.select(
        "period_start",
        (period + step).alias("period_end"),
        F.lit({"day": "daily", "week": "weekly", "month": "monthly"}[every]).alias("period_type"),
        "scope",
        *scopes,
        "total_records",
        "positive_count",
        "neutral_count",
        "negative_count",
        share("positive_count").alias("positive_pct"),
        share("neutral_count").alias("neutral_pct"),
        share("negative_count").alias("negative_pct"),
        half_up(F.col("_score").cast("double") / total, 4).alias("avg_sentiment_score"),
    )


def top_topics(
    records: DataFrame, time: str, every: str = "month", k: int = 3, scopes: Sequence[str] = ()
) -> DataFrame:
    """Most frequent topics of each period, with ``scopes`` also of every value of each dimension.

    Mentions are counted first, by grouping sets that combine before the shuffle; only counts are
    ranked, and a task passes on no more than ``k`` of a period and scope.  Ties go to the smaller
    topic.  Columns: period_start, with scopes also scope and the dimensions, topic, mentions, rank.
    """
    period, topic = F.col("period_start"), F.col("topic")
    rows = records.select(
        F.date_trunc(every, time).cast("timestamp_ntz").alias("period_start"), *scopes, F.explode("topics").alias("topic")
    ).filter(topic.isNotNull())
    if not scopes:
        counts = rows.groupBy(period, topic).agg(F.count("*").alias("mentions"))
        key = ["period_start"]
    else:
        dims = [F.col(s) for s in scopes]
        counts = rows.groupingSets([[period, topic]] + [[period, d, topic] for d in dims], period, *dims, topic).agg(
            *[F.grouping(s).alias(f"_no_{s}") for s in scopes], F.count("*").alias("mentions")
        )
        counts = counts.select(period, _scope(scopes).alias("scope"), *scopes, topic, "mentions")
        key = ["period_start", "scope", *scopes]
    rank = Window.partitionBy(*key).orderBy(F.desc("mentions"), "topic")
    return counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def with_top_topics(rolled: DataFrame, tops: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """A sentiment rollup with the list of the top topics of each row (empty where there is none)."""
    key = ["period_start", "scope", *scopes]
    listed = tops.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("_tops"))
    joined = join_keys(rolled, listed, key, "left")
    return joined.withColumn("top_topics", F.coalesce("_tops.topic", F.array().cast("array<string>"))).drop("_tops")


def sentiment_long(rollup: DataFrame) -> DataFrame:
    """Monthly averages of the positive and negative share as name/value rows."""
    month = F.date_trunc("month", "period_start").cast("date").cast("string").alias("month")
    wide = rollup.groupBy(month).agg(
        F.avg("positive_pct").alias("positive_pct"), F.avg("negative_pct").alias("negative_pct")
    )
    long = wide.unpivot(["month"], ["positive_pct", "negative_pct"], "measure", "value")
    return long.withColumn("value", half_up(F.col("value"), 4))


def document_status(documents: DataFrame) -> DataFrame:
    status = F.col("status")
    return documents.agg(
        *[F.count_if(status == s).alias(s) for s in ("completed", "processing", "failed")]
    )


# --- joins and extracts ------------------------------------------------------------------


def ticket_star(
    tickets: DataFrame, customers: DataFrame, services: DataFrame, products: DataFrame
) -> DataFrame:
    """Tickets with their dimensions.

    Plain left joins: adaptive execution broadcasts a dimension only when its
    measured size is small and splits the partitions of hot keys otherwise.
    """
    return (
        tickets.join(
            customers.select("customer_id", F.col("name").alias("customer_name"), "region", "tier"),
            "customer_id",
            "left",
        )
        .join(services.select("service_id", F.col("name").alias("service_name")), "service_id", "left")
        .join(products, "product_id", "left")
    )


def incident_star(incidents: DataFrame, customers: DataFrame, services: DataFrame) -> DataFrame:
    return incidents.join(
        customers.select("customer_id", F.col("name").alias("customer_name"), "region"),
        "customer_id",
        "left",
    ).join(services.select("service_id", F.col("name").alias("service_name")), "service_id", "left")


def customer_extract(customers: DataFrame, health: DataFrame) -> DataFrame:
    """Customers with their health snapshot, by code."""
    return customers.join(health, "customer_id", "left").orderBy("canonical_id")


def incident_extract(incidents: DataFrame, customers: DataFrame) -> DataFrame:
    """Incidents with the customer name, newest first."""
    names = customers.select("customer_id", F.col("name").alias("customer_name"))
    return incidents.join(names, "customer_id", "left").orderBy(F.desc("occurred_at"), "incident_id")


def sentiment_extract(rollup: DataFrame) -> DataFrame:
    """Rollup with month dates and fixed decimals, by period."""
    month = lambda c: F.date_trunc("month", c).cast("date")
    return rollup.select(
        month("period_start").alias("period_start"),
        month("period_end").alias("period_end"),
        "period_type",
        "scope",
        *SCOPES,
        "total_records",
        "positive_count",
        "neutral_count",
        "negative_count",
        *[F.col(c).cast("decimal(5,2)").alias(c) for c in ("positive_pct", "neutral_pct", "negative_pct")],
        F.col("avg_sentiment_score").cast("decimal(5,4)").alias("avg_sentiment_score"),
    )


# --- keyed updates -------------------------------------------------------------------------


def split_actions(actions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legal actions on known items, and the rest with a reason."""
    known = items.select("item_id").withColumn("_known", F.lit(True))
    tagged = actions.join(known, "item_id", "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), "review item not found").when(
            ~F.col("action").isin(fv.REVIEW_ACTIONS), "invalid action"
        ),
    ).drop("_known")
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(
        F.col("reason").isNotNull()
    )


def apply_review_actions(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items with the outcome of their last legal action."""
    legal = actions.filter(F.col("action").isin(fv.REVIEW_ACTIONS))
    facts = ["reviewer", "note", "edited_value"]
    last = (
        legal.groupBy("item_id")
        .agg(F.max(F.struct("acted_at", "action", *facts)).alias("_a"))
        .select("item_id", "_a.*")
    )
    return items.join(last, "item_id", "left").select(
        *[c for c in items.columns if c != "status"],
        F.coalesce("action", "status").alias("status"),
        F.col("acted_at").alias("reviewed_at"),
        F.col("reviewer").alias("reviewed_by"),
        F.col("note").alias("resolution_note"),
        "edited_value",
    )


def acknowledge(insights: DataFrame, acks: DataFrame) -> DataFrame:
    """Insights with status and person of their last acknowledgement."""
    last = (
        acks.groupBy("insight_id")
        .agg(F.max(F.struct("acted_at", "person")).alias("_a"))
        .select("insight_id", F.col("_a.acted_at").alias("acknowledged_at"), F.col("_a.person").alias("acknowledged_by"))
    )
    return insights.join(last, "insight_id", "left").withColumn(
        "status",
        F.when(F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise(F.col("status")),
    )
