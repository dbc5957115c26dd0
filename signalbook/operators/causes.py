"""Root-cause hypotheses from recurring incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.values import days_before, half_up


def root_causes(
    incidents: DataFrame,
    min_occurrences: int = 3,
    as_of: Column | None = None,
    window_days: int | None = None,
) -> DataFrame:
    """One hypothesis per category with enough incidents.

    One pass counts incidents per category, per category and cause and per
    category and weekday (grouping sets, combined before the shuffle); the
    counts of a category are then folded into one row.
    """
    rows = incidents
    if window_days is not None:
        rows = rows.filter(F.col("occurred_at") >= days_before(as_of, window_days))
    rows = rows.select(
        F.concat_ws(
            "/",
            F.coalesce("category", F.lit("UNKNOWN")),
            F.coalesce("subcategory", F.lit("OTHER")),
        ).alias("category"),
        F.when(F.col("root_cause") != "", F.col("root_cause")).alias("cause"),
        F.weekday("occurred_at").alias("day"),
    )
    c, cause, day = F.col("category"), F.col("cause"), F.col("day")
    counts = rows.groupingSets([[c], [c, cause], [c, day]], c, cause, day).agg(
        F.grouping(cause).alias("_no_cause"),
        F.grouping(day).alias("_no_day"),
        F.count("*").alias("n"),
    )
    by_cause = (F.col("_no_cause") == 0) & cause.isNotNull()
    by_day = (F.col("_no_day") == 0) & day.isNotNull()
    whole = (F.col("_no_cause") == 1) & (F.col("_no_day") == 1)
    folded = (
        counts.groupBy("category")
        .agg(
            F.max(F.when(whole, F.col("n"))).alias("incident_count"),
            # most frequent first, then the smallest value
            F.min(F.when(by_cause, F.struct(-F.col("n"), cause))).alias("_cause"),
            F.min(F.when(by_day, F.struct(-F.col("n"), day))).alias("_day"),
            F.coalesce(F.sum(F.when(by_day, F.col("n"))), F.lit(0)).alias("_dated"),
        )
        .filter(F.col("incident_count") >= min_occurrences)
    )
    n = F.col("incident_count")
    top_n = F.coalesce(-F.col("_cause").getField("col1"), F.lit(0))
    top_cause = F.col("_cause").getField("cause")
    day_n = -F.col("_day").getField("col1")
    weekday = F.element_at(
        F.array(*[F.lit(name) for name in fv.WEEKDAYS]), F.col("_day").getField("day") + 1
    )
    base = F.least(F.lit(0.90), 0.5 + n * 0.05)
    raised = F.when(top_n >= n * 0.5, F.least(F.lit(0.90), base + 0.15)).otherwise(base)
    return folded.select(
        "category",
        "incident_count",
        F.when(top_n >= 2, top_cause)
        .otherwise(fv.ROOT_CAUSE_TEXT["undetermined"])
        .alias("potential_root_cause"),
        top_n.alias("rc_occurrence_count"),
        half_up(top_n * 100.0 / n, 1).alias("rc_pct"),
        F.when(
            (F.col("_dated") >= 3) & (day_n >= F.col("_dated") * 0.4),
            F.format_string(fv.ROOT_CAUSE_TEXT["pattern"], weekday),
        ).alias("temporal_pattern"),
        half_up(raised, 2).alias("confidence"),
        (top_n >= 2).alias("has_hypothesis"),
        F.lit(True).alias("is_hypothesis"),
    )
