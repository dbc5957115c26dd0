"""Topic counts of a recent and an earlier period, and the topics that surge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.functions.values import days_before, half_up


def topic_counts(
    mentions: DataFrame,
    as_of: Column,
    recent_days: int = 30,
    prev_window_days: int | None = None,
    topic: str = "topic",
    created: str = "created_at",
) -> DataFrame:
    """Count each topic in the recent period and before it, in one pass.

    A mention without a time is recent.  "Before" has no lower end unless
    ``prev_window_days`` asks for a true previous window.
    """
    at = F.col(created)
    start = days_before(as_of, recent_days)
    recent = at.isNull() | (at >= start)
    earlier = at < start
    if prev_window_days is not None:
        earlier = earlier & (at >= days_before(start, prev_window_days))
    return (
        mentions.groupBy(F.col(topic).alias("topic"))
        .agg(
            F.count_if(recent).alias("current_count"),
            F.count_if(earlier).alias("previous_count"),
        )
        .filter((F.col("current_count") > 0) | (F.col("previous_count") > 0))
    )


def pair_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Two (topic, count) histograms side by side; a topic not seen before counts 0."""
    return current.select("topic", F.col("count").alias("current_count")).join(
        previous.select("topic", F.col("count").alias("previous_count")), "topic", "left"
    ).withColumn("previous_count", F.coalesce("previous_count", F.lit(0)))


def emerging_topics(
    counts: DataFrame, min_current: int = 5, threshold_pct: float = 100.0
) -> DataFrame:
    """Topics whose count grew by the threshold or more; a new topic counts as +100 %."""
    now, before = F.col("current_count"), F.col("previous_count")
    pct = F.when(before == 0, F.lit(100.0)).otherwise(F.try_divide((now - before) * 100.0, before))
    level = (
        F.when(F.col("_pct") > 300, "CRITICAL").when(F.col("_pct") > 150, "HIGH").otherwise("MEDIUM")
    )
    return (
        counts.filter(now >= min_current)
        .withColumn("_pct", pct)
        .filter(F.col("_pct") >= threshold_pct)
        .select(
            "topic",
            "current_count",
            "previous_count",
            half_up(F.col("_pct"), 1).alias("pct_change"),
            (before == 0).alias("is_new_topic"),
            level.alias("severity"),
        )
    )
