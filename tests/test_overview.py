"""The overview in one aggregate: equal to separate frames, strays included, each fact read once, nothing run early."""

import datetime as dt
import re

from pyspark.sql import functions as F

from signalbook.operators import health, serving
from signalbook.plans import insights as ins
from signalbook.plans.catalog import build

AS_OF = "2024-03-01 00:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


TICKET = "customer_id long, status string, created_at timestamp, sla_breached boolean, sentiment string, resolution_hours double"


def frames(spark, known=True):
    day = lambda n: dt.datetime(2024, 3, 1) - dt.timedelta(days=n)
    tickets = [(c, "open" if n % 3 else "closed", day(n), n % 2 == 0, "negative" if n % 4 else None, None if n % 5 else 9.0) for c in (1, 2, 9, None) for n in range(1, 45, 2 * (c or 1))]
    incidents = [(c, "open" if n % 2 else "resolved", day(n), n % 3 == 0) for c in (2, 2, 8, None) for n in range(1, 50, 7)]
    customers = [(1, "one", 100.0), (2, "two", None), (3, "three", 5.0)] if known else []
    return (
        spark.createDataFrame([(str(i), *rest, i) for i, *rest in customers], "canonical_id string, name string, contract_value double, customer_id long"),
        spark.createDataFrame(tickets, TICKET),
        spark.createDataFrame(incidents, "customer_id long, status string, occurred_at timestamp, sla_breached boolean"),
    )


def test_equals_separate_frames(spark):
    for known in (True, False):
        customers, tickets, incidents = frames(spark, known)
        done = health.ticket_activity(tickets, as_of()), health.incident_activity(incidents, as_of())
        scored = health.customer_health(health.metrics_of_activity(customers, *done))
        found = ins.health_insights(scored, as_of())
        want = serving.kpi_overview(scored, *done, found).first().asDict() | {
            "active_insights": serving.overview_counts(customers, *done, found).first()["active_insights"]
        }
        rows = health.customer_health(health.whole_activity(customers, *done))
        got = serving.activity_overview(rows, ins.notable_health()).first().asDict()
        assert got == want
        assert got["total_tickets"] == tickets.count() and got["total_incidents"] == incidents.count()
        assert got["total_customers"] == (3 if known else 0)


def test_no_rows(spark):
    customers, tickets, incidents = (f.limit(0) for f in frames(spark))
    done = health.ticket_activity(tickets, as_of()), health.incident_activity(incidents, as_of())
    rows = health.customer_health(health.whole_activity(customers, *done))
    assert set(serving.activity_overview(rows, ins.notable_health()).first().asDict().values()) == {0}


def test_lineitem_is_read_once_per_fact_and_nothing_runs_early(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    def refuse(*args, **kwargs):
        raise AssertionError("written while the query was being built")

    monkeypatch.setattr(DataFrameWriter, "parquet", refuse)
    plan = build("kpi_overview")(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet.*lineitem", plan)) <= 2
