"""Metric rollups per customer and service, and the customer health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbook import fixed_values as fv
from signalbook.functions.values import days_before, half_up, money


def ticket_activity(tickets: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """One row per customer: its tickets in the window and the one before, and all of them by status.

    A customer with very many tickets costs one combined counter per task.
    """
    start = days_before(as_of, window_days)
    created = F.col("created_at")
    current = (created >= start) & (created < as_of)
    earlier = (created >= days_before(as_of, 2 * window_days)) & (created < start)
    return tickets.groupBy("customer_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(current).alias("ticket_count"),
        F.count_if(earlier).alias("ticket_count_prev"),
        F.count_if(current & F.col("sla_breached")).alias("sla_breach_count"),
        F.count_if(current & (F.col("sentiment") == "negative")).alias("_negative"),
        F.sum(F.when(current, money(F.col("resolution_hours")))).alias("_hours"),
        F.count_if(current & F.col("resolution_hours").isNotNull()).alias("_resolved"),
    )


def incident_activity(incidents: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """One row per customer: its incidents in the window, and all of them by status and breach."""
    occurred = F.col("occurred_at")
    return incidents.groupBy("customer_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if("sla_breached").alias("breached"),
        F.count_if((occurred >= days_before(as_of, window_days)) & (occurred < as_of)).alias("incident_count"),
    )


def customer_metrics(
    customers: DataFrame,
    tickets: DataFrame,
    incidents: DataFrame,
    as_of: Column,
    window_days: int = 30,
) -> DataFrame:
    """Activity of each customer in the window and the window before it.

    Every fact is filtered to the two windows (the filter reaches the scan) and
    folded to one row per customer before it meets the dimension, so no join
    multiplies rows.
    """
    start, prev_start = days_before(as_of, window_days), days_before(as_of, 2 * window_days)
    created, occurred = F.col("created_at"), F.col("occurred_at")
    recent = tickets.filter((created >= prev_start) & (created < as_of))
    happened = incidents.filter((occurred >= start) & (occurred < as_of))
    return metrics_of_activity(
        customers,
        ticket_activity(recent, as_of, window_days),
        incident_activity(happened, as_of, window_days),
    )


def _metrics() -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        F.col("customer_id"),
        F.col("canonical_id"),
        F.col("name"),
        F.coalesce("ticket_count", zero).alias("ticket_count"),
        F.coalesce("ticket_count_prev", zero).alias("ticket_count_prev"),
        F.coalesce("incident_count", zero).alias("incident_count"),
        F.coalesce("sla_breach_count", zero).alias("sla_breach_count"),
        F.coalesce(
            F.try_divide(F.col("_hours").cast("double"), F.col("_resolved")), F.lit(0.0)
        ).alias("avg_resolution_hours"),
        F.coalesce(
            F.try_divide(F.col("_negative") * 100.0, F.col("ticket_count")), F.lit(0.0)
        ).alias("negative_pct"),
        F.coalesce(F.col("contract_value").cast("double"), F.lit(0.0)).alias("contract_value"),
    ]


def metrics_of_activity(customers: DataFrame, by_ticket: DataFrame, by_incident: DataFrame) -> DataFrame:
    """Customers with the counts of :func:`ticket_activity` and :func:`incident_activity`."""
    return (
        customers.select("customer_id", "canonical_id", "name", "contract_value")
        .join(by_ticket.drop("total", "open"), "customer_id", "left")
        .join(by_incident.select("customer_id", "incident_count"), "customer_id", "left")
        .select(*_metrics())
    )


#: Counts of all tickets and incidents of a customer, kept by :func:`whole_activity`.
TOTALS = ("tickets", "tickets_open", "incidents", "incidents_open", "incidents_breached")


def whole_activity(customers: DataFrame, by_ticket: DataFrame, by_incident: DataFrame) -> DataFrame:
    """:func:`metrics_of_activity` with all counts (``TOTALS``) and is_customer.

    Tickets and incidents of customers that are not known, or of none, have rows of their own, so that
    sums over the rows are sums over the facts; each fact is read once.
    """
    zero = F.lit(0).cast("bigint")
    return (
        customers.select("customer_id", "canonical_id", "name", "contract_value", F.lit(True).alias("_known"))
        .join(by_ticket.withColumnsRenamed({"total": "tickets", "open": "tickets_open"}), "customer_id", "full")
        .join(
            by_incident.withColumnsRenamed(
                {"total": "incidents", "open": "incidents_open", "breached": "incidents_breached"}
            ),
            "customer_id",
            "full",
        )
        .select(
            *_metrics(),
            *[F.coalesce(c, zero).alias(c) for c in TOTALS],
            F.col("_known").isNotNull().alias("is_customer"),
        )
    )


def risk_level(score: Column) -> Column:
    out = F.lit(fv.LOWEST_RISK_BAND)
    for lowest, name in reversed(fv.RISK_BANDS):
        out = F.when(score >= lowest, name).otherwise(out)
    return out


def _floor_zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def customer_health(metrics: DataFrame, rating: Column | None = None) -> DataFrame:
    """Health score 0-100 with components, risk level, trend and revenue at risk.

    The level is taken from the score as rounded to one decimal.  Everything is
    plain column arithmetic: no shuffle beyond that of the metrics.
    """
    n, before = F.col("ticket_count"), F.col("ticket_count_prev")
    hours = F.col("avg_resolution_hours")
    rating = F.lit(None).cast("double") if rating is None else rating
    change = F.when(before > 0, (n - before) * 100.0 / before).otherwise(F.lit(0.0))
    parts = metrics.withColumn("_change", change).select(
        "*",
        _floor_zero(
            _floor_zero(100.0 - 8 * _floor_zero((n - 2).cast("double")))
            - _floor_zero(F.col("_change") * 0.3)
        ).alias("_ticket"),
        _floor_zero(100.0 - F.col("negative_pct") * 1.2).alias("_sentiment"),
        _floor_zero(100.0 - F.col("sla_breach_count") * 15).alias("_sla"),
        F.when(hours == 0, 80.0)
        .when(hours <= 4, 100.0)
        .when(hours <= 24, 100 - (hours - 4) * 3.3)
        .otherwise(_floor_zero(100 - hours * 2))
        .alias("_resolution"),
        _floor_zero(100.0 - F.col("incident_count") * 10).alias("_incident"),
        F.coalesce((rating - 1) / 4 * 100, F.lit(70.0)).alias("_rating"),
    )
    weighted = sum(F.col(f"_{part}") * weight for part, weight in fv.HEALTH_WEIGHTS.items())
    scored = parts.withColumn(
        "health_score", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted)), 1)
    )
    change, negative, score = F.col("_change"), F.col("negative_pct"), F.col("health_score")
    at_risk = half_up(F.col("contract_value") * (100 - score) / 100 * 0.8, 2)
    return scored.select(
        *metrics.columns,
        "health_score",
        risk_level(score).alias("risk_level"),
        F.when((change > 20) | (negative > 40), "DETERIORATING")
        .when(change < -10, "IMPROVING")
        .otherwise("STABLE")
        .alias("trend"),
        half_up(F.col("_ticket"), 1).alias("ticket_frequency"),
        half_up(F.col("_sentiment"), 1).alias("sentiment"),
        half_up(F.col("_sla"), 1).alias("sla_compliance"),
        half_up(F.col("_resolution"), 1).alias("resolution_time"),
        half_up(F.col("_incident"), 1).alias("incident_frequency"),
        half_up(F.col("_rating"), 1).alias("customer_rating"),
        half_up(change, 1).alias("ticket_change_pct"),
        F.when((F.col("contract_value") > 0) & (at_risk > 0), at_risk).alias("revenue_at_risk"),
    )


def latest_snapshot(snapshots: DataFrame, key: str = "customer_id", at: str = "snapshot_date") -> DataFrame:
    """The newest row of each key, folded before the shuffle."""
    rest = [c for c in snapshots.columns if c != key]
    newest = F.max(F.struct(at, *[c for c in rest if c != at])).alias("_s")
    return snapshots.groupBy(key).agg(newest).select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def service_metrics(
    services: DataFrame,
    tickets: DataFrame,
    incidents: DataFrame,
    as_of: Column,
    window_days: int = 30,
    top_causes: int = 3,
) -> DataFrame:
    """Incidents, resolution, SLA compliance, availability and top causes per service."""
    start = days_before(as_of, window_days)
    created, occurred = F.col("created_at"), F.col("occurred_at")
    by_ticket = (
        tickets.filter((created >= start) & (created < as_of))
        .groupBy("service_id")
        .agg(
            F.count("*").alias("_tickets"),
            F.count_if(~F.col("sla_breached")).alias("_kept"),
            F.sum(money(F.col("resolution_hours"))).alias("_hours"),
            F.count("resolution_hours").alias("_resolved"),
        )
    )
    recent = incidents.filter((occurred >= start) & (occurred < as_of))
    # Per service and cause first: the fold to one row per service then sees few rows.
    per_cause = recent.groupBy("service_id", "root_cause").agg(
        F.count("*").alias("n"), F.sum(money(F.col("downtime_minutes"))).alias("_down")
    )
    by_incident = per_cause.groupBy("service_id").agg(
        F.sum("n").alias("incident_count"), F.sum("_down").alias("_down")
    )
    rank = Window.partitionBy("service_id").orderBy(F.desc("n"), "root_cause")
    causes = (
        per_cause.filter(F.col("root_cause") != "")
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= top_causes)
        .groupBy("service_id")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "root_cause"))).alias("_top"))
    )
    minutes = window_days * 24 * 60
    return (
        services.select("service_id", "name")
        .join(by_ticket, "service_id", "left")
        .join(by_incident, "service_id", "left")
        .join(causes, "service_id", "left")
        .select(
            "service_id",
            "name",
            F.coalesce("incident_count", F.lit(0).cast("bigint")).alias("incident_count"),
            half_up(F.try_divide(F.col("_hours").cast("double"), F.col("_resolved")), 4).alias(
                "avg_resolution_hours"
            ),
            half_up(F.try_divide(F.col("_kept") * 100.0, F.col("_tickets")), 2).alias(
                "sla_compliance_pct"
            ),
            half_up(
                100 - F.coalesce(F.col("_down").cast("double"), F.lit(0.0)) * 100.0 / minutes, 4
            ).alias("availability_pct"),
            F.coalesce(F.col("_top.root_cause"), F.array().cast("array<string>")).alias(
                "top_root_causes"
            ),
        )
    )
