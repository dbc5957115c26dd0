"""Canned questions: tag a question with an intent, and the query of each intent."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.text import strip
from signalbook.operators import serving


def intent(question: Column, table: Sequence[tuple[str, str]] = fv.QUESTION_INTENTS) -> Column:
    """The intent of the first pattern found, else ``unknown``."""
    text = F.lower(strip(question))
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for p, name in table], F.lit("unknown"))


def answers(
    customers: DataFrame,
    tickets: DataFrame,
    incidents: DataFrame,
    insights: DataFrame,
    rollup: DataFrame,
    as_of: Column,
) -> dict[str, Callable[[], DataFrame]]:
    """The query behind each intent, built only when called."""
    return {
        "top_risk_customers": lambda: serving.top_risk_customers(customers),
        "recent_incidents": lambda: serving.recent_incidents(incidents, as_of),
        "negative_sentiment_services": lambda: serving.negative_services(rollup),
        "sla_and_sentiment": lambda: serving.breach_and_sentiment(tickets),
        "overview": lambda: serving.overview_counts(
            customers, tickets.agg(F.count("*").alias("total")), incidents.agg(F.count("*").alias("total")), insights
        ),
    }


def answer(
    question: str, *inputs: DataFrame | Column, table: Sequence[tuple[str, str]] = fv.QUESTION_INTENTS
) -> DataFrame:
    """The answer to one question: its intent by the patterns of :func:`intent`, then its query."""
    text = question.strip().lower()
    name = next((name for pattern, name in table if re.search(pattern, text)), None)
    found = answers(*inputs).get(name)
    if found is None:
        raise ValueError(f"no query answers: {question}")
    return found()
