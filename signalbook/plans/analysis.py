"""The full analysis: from the star schema to a ranked list of insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.functions.values import half_up
from signalbook.operators.causes import root_causes
from signalbook.operators.health import customer_health, customer_metrics
from signalbook.operators.topics import emerging_topics, topic_counts
from signalbook.plans import insights as ins


def scored_customers(
    customers: DataFrame, tickets: DataFrame, incidents: DataFrame, as_of: Column, window_days: int
) -> DataFrame:
    """Customers with health, risk, trend and a churn risk of 1 - health/100."""
    health = customer_health(customer_metrics(customers, tickets, incidents, as_of, window_days))
    return health.withColumn("churn_risk_score", half_up(1 - F.col("health_score") / 100, 4))


def full_analysis(
    customers: DataFrame,
    tickets: DataFrame,
    incidents: DataFrame,
    topic_mentions: DataFrame,
    as_of: Column,
    topics_as_of: Column,
    window_days: int = 30,
    recent_days: int = 30,
    prev_window_days: int | None = None,
    top_topics: int = 5,
    top_causes: int = 3,
) -> DataFrame:
    """Health, emerging-topic and root-cause insights in one prioritised list."""
    health = customer_health(customer_metrics(customers, tickets, incidents, as_of, window_days))
    counts = topic_counts(topic_mentions, topics_as_of, recent_days, prev_window_days)
    return ins.prioritized(
        ins.health_insights(health, as_of),
        ins.emerging_insights(emerging_topics(counts), as_of, top_topics),
        ins.root_cause_insights(root_causes(incidents), as_of, top_causes),
    )
