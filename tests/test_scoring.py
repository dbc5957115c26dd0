"""Scores on hand-made rows against plain restatements of the rules."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from signalbook.functions.values import instant
from signalbook.operators import causes, health, impact, series, topics


def half_up(value, places):
    exact = Decimal(repr(value)).quantize(Decimal(1).scaleb(-10), ROUND_HALF_UP)
    return float(exact.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


METRICS = "customer_id string, canonical_id string, name string, ticket_count long, ticket_count_prev long, incident_count long, sla_breach_count long, avg_resolution_hours double, negative_pct double, contract_value double"


def expected_health(n, prev, incidents, breaches, hours, negative, rating):
    change = (n - prev) * 100 / prev if prev else 0.0
    ticket = max(0.0, max(0.0, 100 - 8 * max(0, n - 2)) - max(0.0, 0.3 * change))
    if hours == 0:
        resolution = 80.0
    elif hours <= 4:
        resolution = 100.0
    elif hours <= 24:
        resolution = 100 - 3.3 * (hours - 4)
    else:
        resolution = max(0.0, 100 - 2 * hours)
    stars = 70.0 if rating is None else (rating - 1) * 25
    total = (
        0.25 * ticket + 0.25 * max(0.0, 100 - 1.2 * negative) + 0.2 * max(0, 100 - 15 * breaches)
        + 0.15 * resolution + 0.1 * max(0, 100 - 10 * incidents) + 0.05 * stars
    )
    return half_up(min(100.0, max(0.0, total)), 1)


def test_health_boundaries(spark):
    cases = [
        (n, prev, inc, br, h, neg, rating)
        for n, prev in ((0, 0), (2, 2), (3, 0), (10, 5), (20, 1), (5, 10))
        for inc, br in ((0, 0), (3, 2), (12, 9))
        for h in (0.0, 4.0, 4.1, 24.0, 24.1, 48.0, 60.0)
        for neg in (0.0, 40.0, 90.0)
        for rating in (None, 1.0, 5.0)
    ]
    rows = [(str(i), str(i), "x", n, p, inc, br, h, neg, 1000.0) for i, (n, p, inc, br, h, neg, _) in enumerate(cases)]
    ratings = spark.createDataFrame([(str(i), c[6]) for i, c in enumerate(cases)], "customer_id string, rating double")
    metrics = spark.createDataFrame(rows, METRICS).join(ratings, "customer_id")
    got = {int(r.customer_id): r for r in health.customer_health(metrics, F.col("rating")).collect()}
    for i, case in enumerate(cases):
        score = expected_health(*case)
        assert got[i].health_score == score, case
        level = "LOW" if score >= 75 else "MEDIUM" if score >= 55 else "HIGH" if score >= 35 else "CRITICAL"
        assert got[i].risk_level == level
        loss = half_up(1000 * (100 - score) / 100 * 0.8, 2)
        assert got[i].revenue_at_risk == (loss or None)


def test_more_breaches_never_help(spark):
    rows = [(str(i), "c", "n", 4, 4, 1, i, 10.0, 20.0, 0.0) for i in range(12)]
    got = health.customer_health(spark.createDataFrame(rows, METRICS)).collect()
    scores = [r.health_score for r in sorted(got, key=lambda r: int(r.customer_id))]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 100 for s in scores)
    assert all(r.revenue_at_risk is None for r in got)


def series_frame(spark, data):
    rows = [(k, t, float(v)) for k, values in data.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t int, value double")


def test_trend(spark):
    data = {"short": [1, 2], "flat": [5, 5, 5, 5], "zero": [0, 1, 2], "stable": [100, 90, 101], "up": [1, 2, 4], "down": [9, 5, 1]}
    got = {r.k: r for r in series.trend(series_frame(spark, data), ["k"], F.floor(F.col("t") / 2)).collect()}
    assert "short" not in got
    assert (got["flat"].direction, got["flat"].slope, got["flat"].r_squared, got["flat"].confidence) == ("STABLE", 0.0, 0.0, 0.5)
    assert (got["zero"].pct_change, got["zero"].direction) == (0.0, "STABLE")
    assert got["stable"].direction == "STABLE"
    assert (got["up"].direction, got["up"].slope, got["up"].pct_change) == ("INCREASING", 1.5, 300.0)
    assert (got["down"].direction, got["down"].slope, got["down"].r_squared) == ("DECREASING", -4.0, 1.0)


def test_zscore(spark):
    data = {"few": [1, 1, 1, 99], "same": [3] * 8, "spike": [10, 11, 9, 10, 11, 9, 10, 11, 9, 10, 30], "huge": [1, 2] * 15 + [90]}
    got = series.zscore_anomalies(series_frame(spark, data), ["k"]).collect()
    assert {(r.k, r.value, r.severity) for r in got} == {("spike", 30.0, "MEDIUM"), ("huge", 90.0, "HIGH")}


def expected_iqr(values):
    ordered, n = sorted(values), len(values)
    if n < 5:
        return set()
    q1, q3 = ordered[n // 4], ordered[3 * n // 4]
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return {(t, "HIGH" if v > 2 * hi or v < lo / 2 else "MEDIUM") for t, v in enumerate(values) if v < lo or v > hi}


def test_iqr_against_sorting(spark):
    rng = random.Random(3)
    data = {f"n{n}": [rng.choice([rng.gauss(0, 5), rng.gauss(50, 1)]) for _ in range(n)] for n in (3, 5, 7, 8, 9, 12, 100, 101)}
    data["spread"] = [1, 2, 3, 4, 5, 6, 7, 8, 30, 15, -40]
    got = series.iqr_anomalies(series_frame(spark, data), ["k"]).collect()
    for k, values in data.items():
        assert {(r.t, r.severity) for r in got if r.k == k} == expected_iqr([float(v) for v in values]), k


def test_exact_ranks_of_a_long_group(spark):
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        ((F.col("id") * 7919) % 100_003).cast("double").alias("value"),
    )
    exact = {}
    for r in rows.collect():
        exact.setdefault(r.k, []).append(r.value)
    got = series.quartiles(rows, ["k"]).collect()
    assert len(got) == len(exact)
    for r in got:
        v = sorted(exact[r.k])
        n = len(v)
        assert (r.q1, r.q3, r.median) == (v[n // 4], v[3 * n // 4], (v[(n - 1) // 2] + v[n // 2]) / 2)


def test_rolling_blocks_change_nothing(spark):
    rng = random.Random(5)
    frame = series_frame(spark, {"a": [rng.uniform(1, 100) for _ in range(60)], "b": [5.0] * 10})
    whole = series.rolling_anomalies(frame, ["k"], F.lit(0), width=4, block=1000)
    cut = series.rolling_anomalies(frame, ["k"], F.floor(F.col("t") / 7), width=4, block=5)
    assert sorted(whole.collect()) == sorted(cut.collect())
    assert whole.count() > 0


def test_emerging_boundaries(spark):
    now = spark.createDataFrame([("few", 4), ("new", 5), ("less", 199), ("double", 200), ("high", 251), ("crit", 401)], "topic string, count long")
    before = spark.createDataFrame([("less", 100), ("double", 100), ("high", 100), ("crit", 100)], "topic string, count long")
    got = {r.topic: r for r in topics.emerging_topics(topics.pair_counts(now, before)).collect()}
    assert {t: r.severity for t, r in got.items()} == {"new": "MEDIUM", "double": "MEDIUM", "high": "HIGH", "crit": "CRITICAL"}
    assert got["new"].is_new_topic and got["new"].pct_change == 100.0


def test_topic_without_time_is_recent(spark):
    rows = spark.createDataFrame([("a", None), ("a", "2024-01-01 00:00:00"), ("a", "2023-01-01 00:00:00")], "topic string, at string")
    rows = rows.select("topic", F.col("at").cast("timestamp_ntz").alias("created_at"))
    r = topics.topic_counts(rows, instant("2024-01-20 00:00:00")).first()
    assert (r.current_count, r.previous_count) == (2, 1)


INCIDENTS = "category string, subcategory string, root_cause string, occurred_at string"


def test_root_causes(spark):
    monday, tuesday = "2024-01-01 10:00:00", "2024-01-02 10:00:00"
    rows = [("A", "x", "disk", monday)] * 2 + [("A", "x", "cpu", tuesday)]
    rows += [("B", "y", "one", monday), ("B", "y", "two", tuesday), ("B", "y", "", None)]
    rows += [("C", "z", "a", monday), ("C", "z", "a", monday)]
    rows += [(None, None, None, None)] * 3
    frame = spark.createDataFrame(rows, INCIDENTS).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    got = {r.category: r for r in causes.root_causes(frame).collect()}
    assert set(got) == {"A/x", "B/y", "UNKNOWN/OTHER"}
    assert (got["A/x"].potential_root_cause, got["A/x"].rc_pct, got["A/x"].confidence, got["A/x"].temporal_pattern) == ("disk", 66.7, 0.8, "Clustering on Mondays")
    assert got["B/y"].potential_root_cause.startswith("Undetermined") and got["B/y"].temporal_pattern is None
    assert got["UNKNOWN/OTHER"].rc_occurrence_count == 0


@pytest.mark.parametrize("sev,conf,kind,people,money", [("CRITICAL", 0.9, "risk", 1, None), ("odd", 0.5, "odd", None, 5000.0), ("HIGH", 1.0, "sla_risk", 10**9, 9e6), ("LOW", 0.4, "trend", 0, 20000.0)])
def test_priority(spark, sev, conf, kind, people, money):
    weight = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.5, "LOW": 0.25}.get(sev, 0.5)
    urgency = {"risk": 0.9, "sla_risk": 0.95, "trend": 0.6}.get(kind, 0.5)
    reach = min(1.0, math.log(max(people or 1, 1) + 1) / 10)
    bonus = min(0.2, money / 500000) if money and money > 10000 else 0.0
    want = half_up(min(1.0, weight * conf * urgency * (0.5 + reach / 2) + bonus), 4)
    row = spark.createDataFrame([(sev, conf, kind, people, money)], "s string, c double, k string, p long, m double")
    assert row.select(impact.priority_score(F.col("s"), F.col("c"), F.col("k"), F.col("p"), F.col("m"))).first()[0] == want


def test_impact(spark):
    row = spark.createDataFrame([(90.0, 200, 0.0, 3, 0.0), (60.0, 1000, 500.0, 0, 1000.0)], "m double, u int, r double, b int, v double")
    got = row.select(
        impact.downtime_impact(F.col("m"), F.col("u"), F.col("r")).alias("d"), impact.sla_penalty(F.col("b"), F.col("v")).alias("p")
    ).collect()
    assert tuple(got[0].d) == (1.5, 15000.0, 4500.0) and tuple(got[1].d) == (1.0, 500.0, 500.0)
    assert tuple(got[0].p) == (15000.0, None, 15000.0) and tuple(got[1].p) == (0.0, 600.0, 600.0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=5, max_size=40))
def test_iqr_property(spark, values):
    got = series.iqr_anomalies(series_frame(spark, {"k": values}), ["k"]).collect()
    assert {(r.t, r.severity) for r in got} == expected_iqr([float(v) for v in values])
