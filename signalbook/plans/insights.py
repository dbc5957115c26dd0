"""Insights in words: customer health, emerging topics, SLA risk and root causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.values import (
    fixed_text,
    grouped_text,
    half_even_text,
    half_up,
    stable_id,
    title_case,
)
from signalbook.operators.impact import priority_score

EVIDENCE = "array<struct<label:string,value:string,source_type:string>>"


def _evidence(*entries: tuple[str, Column, str, Column | None]) -> Column:
    """Evidence entries (label, value, source, condition); entries not met are left out."""
    made = []
    for label, value, source, condition in entries:
        entry = F.struct(
            F.lit(label).alias("label"), value.alias("value"), F.lit(source).alias("source_type")
        )
        made.append(entry if condition is None else F.when(condition, entry))
    return F.array_compact(F.array(*made)).cast(EVIDENCE)


def _insight(df: DataFrame, as_of: Column, **columns) -> DataFrame:
    """The insight row: given columns, priority, stable id and defaults."""
    none = F.lit(None)
    c = {k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()}
    entity = c.get("key", F.coalesce(c.get("entity_id", none).cast("string"), c["entity_name"]))
    money = c.get("financial_impact_estimate", none).cast("double")
    people = c["affected_population"].cast("bigint")
    order = [
        "insight_type", "title", "description", "what_happened", "why_it_matters",
        "recommended_action", "severity",
    ]
    return df.select(
        stable_id(c["insight_type"], entity).alias("insight_id"),
        *[c[name].alias(name) for name in order],
        c["confidence"].cast("double").alias("confidence"),
        c["entity_type"].alias("entity_type"),
        c.get("entity_id", none).cast("string").alias("entity_id"),
        c["entity_name"].alias("entity_name"),
        c["metric_name"].alias("metric_name"),
        c["current_value"].cast("double").alias("current_value"),
        c.get("baseline_value", none).cast("double").alias("baseline_value"),
        c.get("change_pct", none).cast("double").alias("change_pct"),
        c["evidence"].alias("evidence"),
        c["contributing_factors"].alias("contributing_factors"),
        money.alias("financial_impact_estimate"),
        people.alias("affected_population"),
        priority_score(
            c["severity"], c["confidence"].cast("double"), c["insight_type"], people, money
        ).alias("priority_score"),
        F.lit("insight_engine").alias("generated_by"),
        F.lit(False).alias("is_cross_domain"),
        F.lit("active").alias("status"),
        as_of.alias("created_at"),
    )


def notable_health() -> Column:
    """Whether a customer gets an insight: not at low risk, or getting worse."""
    return (F.col("risk_level") != "LOW") | (F.col("trend") == "DETERIORATING")


def health_insights(health: DataFrame, as_of: Column) -> DataFrame:
    """One insight per customer that is not at low risk, or is getting worse."""
    text = fv.HEALTH_TEXT
    name, score, risk = F.col("name"), F.col("health_score"), F.col("risk_level")
    shown = score.cast("string")
    change, loss = F.col("ticket_change_pct"), F.col("revenue_at_risk")
    factors = F.array_compact(
        F.array(*[F.when(F.col(part) < low, F.lit(words)) for part, low, words in fv.HEALTH_FACTORS])
    )
    named = F.array_join(F.slice(factors, 1, 3), ", ")
    signed = F.concat(F.when(change >= 0, "+").otherwise(""), fixed_text(change, 1), F.lit("%"))
    notable = health.filter(notable_health())
    return _insight(
        notable,
        as_of,
        insight_type="risk",
        title=F.format_string(text["title"], name),
        description=F.format_string(text["description"], name, shown, risk),
        what_happened=F.format_string(
            text["what_happened"], name, shown, risk, F.lower("trend")
        ),
        why_it_matters=F.concat(
            F.lit(text["why_start"]),
            F.when(loss > 0, F.format_string(text["why_money"], grouped_text(loss))).otherwise(""),
            F.lit(text["why_end"]),
        ),
        recommended_action=F.format_string(
            text["action"], name, F.when(named != "", named).otherwise(text["no_factors"])
        ),
        severity=risk,
        confidence=0.82,
        entity_type="customer",
        entity_id=F.col("customer_id"),
        entity_name=name,
        metric_name="customer_health_score",
        current_value=score,
        baseline_value=100.0,
        change_pct=half_up(score - 100, 1),
        evidence=_evidence(
            ("Ticket volume change", signed, "ticket", F.abs(change) > 10),
            (
                "Estimated revenue at risk (ESTIMATED)",
                F.concat(F.lit("$"), grouped_text(loss)),
                "analytics",
                loss > 0,
            ),
        ),
        contributing_factors=factors,
        financial_impact_estimate=loss,
        affected_population=1,
    )


def emerging_insights(emerging: DataFrame, as_of: Column, k: int | None = 5) -> DataFrame:
    """Insights for the topics that grew most; ``k=None`` writes one for every topic."""
    text = fv.EMERGING_TEXT
    if k is not None:
        emerging = emerging.orderBy(F.desc("pct_change"), "topic").limit(k)
    topic = title_case(F.translate("topic", "_", " "))
    now, before = F.col("current_count"), F.col("previous_count")
    pct = half_even_text(F.col("pct_change"))
    return _insight(
        emerging,
        as_of,
        insight_type="emerging_issue",
        key=F.col("topic"),
        title=F.format_string(text["title"], topic),
        description=F.format_string(text["description"], topic, pct),
        what_happened=F.format_string(
            text["what_happened"], topic, before.cast("string"), now.cast("string"), pct,
            F.when(F.col("pct_change") > 100, "surge").otherwise("increase"),
        ),
        why_it_matters=F.format_string(text["why_it_matters"], topic),
        recommended_action=F.format_string(text["action"], topic),
        severity=F.col("severity"),
        confidence=0.78,
        entity_type="issue_category",
        entity_name=topic,
        metric_name=F.concat(topic, F.lit("_complaint_count")),
        current_value=now,
        baseline_value=before,
        change_pct=F.col("pct_change"),
        evidence=_evidence(
            ("Current period count", now.cast("string"), "ticket", None),
            ("Previous period count", before.cast("string"), "ticket", None),
            ("Change", F.concat(F.lit("+"), pct, F.lit("%")), "analytics", None),
        ),
        contributing_factors=F.array(F.format_string(text["factor"], topic)),
        affected_population=now,
    )


def elapsed_share(elapsed: Column, target: Column) -> Column:
    """Our stand-in for a breach probability: used share of the allowed time, at most 1."""
    return F.least(F.lit(1.0), elapsed / target)


def sla_risk_insights(tickets: DataFrame, as_of: Column) -> DataFrame:
    """Insights for tickets whose ``breach_probability`` is at least one half.

    Needs ticket_number, ticket_id, customer_name, severity, elapsed_hours,
    sla_hours and breach_probability.
    """
    text = fv.SLA_RISK_TEXT
    number, who, level = F.col("ticket_number"), F.col("customer_name"), F.col("severity")
    p, elapsed, target = F.col("breach_probability"), F.col("elapsed_hours"), F.col("sla_hours")
    left = fixed_text(F.greatest(F.lit(0.0), target - elapsed), 1)
    spent, allowed = fixed_text(elapsed, 1), half_even_text(target)
    return _insight(
        tickets.filter(p >= 0.5),
        as_of,
        insight_type="sla_risk",
        title=F.format_string(text["title"], number),
        description=F.format_string(text["description"], number, who, half_even_text(p * 100)),
        what_happened=F.format_string(text["what_happened"], number, level, spent, allowed, left),
        why_it_matters=F.format_string(text["why_it_matters"], level, who),
        recommended_action=F.format_string(text["action"], number, who),
        severity=F.when(p > 0.85, "CRITICAL").otherwise("HIGH"),
        confidence=half_up(p, 6),
        entity_type="ticket",
        entity_id=F.col("ticket_id"),
        entity_name=number,
        metric_name="sla_breach_probability",
        current_value=half_up(p * 100, 4),
        baseline_value=0.0,
        change_pct=half_up(p * 100, 4),
        evidence=_evidence(
            ("Elapsed time", F.concat(spent, F.lit("h")), "ticket", None),
            ("SLA target", F.concat(allowed, F.lit("h")), "ticket", None),
            ("Time remaining", F.concat(left, F.lit("h")), "analytics", None),
        ),
        contributing_factors=F.array(
            F.lit("Extended open time"), F.concat(level, F.lit(" priority"))
        ),
        affected_population=1,
    )


def root_cause_insights(causes: DataFrame, as_of: Column, k: int | None = 3) -> DataFrame:
    """Insights for the largest recurring categories with enough confidence."""
    text = fv.ROOT_CAUSE_TEXT
    if k is not None:
        causes = causes.orderBy(F.desc("incident_count"), "category").limit(k)
    category, n, cause = F.col("category"), F.col("incident_count"), F.col("potential_root_cause")
    count = n.cast("string")
    return _insight(
        causes.filter(F.col("confidence") > 0.6),
        as_of,
        insight_type="root_cause",
        title=F.format_string(text["title"], category),
        description=F.format_string(text["description"], count, category, cause),
        what_happened=F.format_string(text["what_happened"], count, category),
        why_it_matters=text["why_it_matters"],
        recommended_action=F.when(
            F.col("has_hypothesis"), F.format_string(text["action_known"], category, cause)
        ).otherwise(F.format_string(text["action_unknown"], category)),
        severity=F.when(n >= 5, "HIGH").otherwise("MEDIUM"),
        confidence=F.col("confidence"),
        entity_type="incident_category",
        entity_name=category,
        metric_name="incident_count",
        current_value=n,
        evidence=_evidence(
            ("Total incidents", count, "incident", None),
            (
                "Potential root cause",
                F.concat(cause, F.lit(" ("), F.col("rc_pct").cast("string"), F.lit("% of incidents) [HYPOTHESIS]")),
                "analytics",
                None,
            ),
        ),
        contributing_factors=F.array(cause),
        affected_population=n,
    )


def prioritized(*parts: DataFrame) -> DataFrame:
    """All insights, highest priority first."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.desc("priority_score"), "insight_id")


def narrative(title: Column, entity: Column, metric: Column, change_pct: Column) -> Column:
    """One sentence about a change."""
    change = F.coalesce(change_pct, F.lit(0.0))
    way = F.when(change > 0, "increased").otherwise("decreased")
    return F.format_string(
        fv.NARRATIVE_TEXT, entity, F.lower(title), metric, way, fixed_text(F.abs(change), 1)
    )
