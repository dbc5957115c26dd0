"""Estimated money impact and the priority of an insight.  Estimates, not bookings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.values import half_up, lookup


def downtime_impact(
    minutes: Column, affected_users: Column, revenue_per_hour: Column | None = None
) -> Column:
    """Struct of hours, rate used and estimated loss; a missing or zero rate takes the default."""
    default = F.lit(fv.TRANSACTIONS_PER_HOUR * fv.REVENUE_PER_TRANSACTION)
    rate = default
    if revenue_per_hour is not None:
        rate = F.coalesce(F.when(revenue_per_hour != 0, revenue_per_hour), default)
    hours = minutes / 60
    return F.struct(
        half_up(hours, 2).alias("downtime_hours"),
        rate.alias("revenue_per_hour"),
        half_up(hours * rate * (affected_users / 1000), 2).alias("estimated_revenue_loss"),
    )


def sla_penalty(
    breaches: Column,
    contract_value: Column,
    penalty_per_breach: float = fv.PENALTY_PER_BREACH,
) -> Column:
    """Struct of direct penalty, value at risk of churn and their sum."""
    direct = breaches * F.lit(penalty_per_breach)
    churn = F.when(contract_value != 0, contract_value * fv.CHURN_SHARE)
    return F.struct(
        half_up(direct, 2).alias("direct_penalty_estimate"),
        half_up(churn, 2).alias("churn_risk_value"),
        half_up(direct + F.coalesce(churn, F.lit(0.0)), 2).alias("total_exposure"),
    )


def priority_score(
    severity: Column,
    confidence: Column,
    insight_type: Column,
    population: Column,
    impact: Column,
) -> Column:
    """Severity x confidence x urgency x population, plus a bonus for large sums; at most 1."""
    people = F.greatest(F.coalesce(population, F.lit(1)), F.lit(1))
    reach = F.least(F.lit(1.0), F.ln(people + 1) / 10)
    bonus = F.when(impact > 10000, F.least(F.lit(0.2), impact / 500000)).otherwise(0.0)
    raw = (
        lookup(fv.SEVERITY_WEIGHTS, severity, 0.5)
        * confidence
        * lookup(fv.INSIGHT_URGENCY, insight_type, 0.5)
        * (0.5 + reach * 0.5)
    )
    return half_up(F.least(F.lit(1.0), raw + bonus), 4)
