"""Document run: extract, resolve, load facts, queue reviews."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbook.operators import resolve, staging
from signalbook.session import cut_lineage


@dataclass
class Run:
    """The frames of one document run; each is one sink, made when it is asked for.

    Extraction is row-local, so a sink reads the texts and extracts only what it holds.  Names alone are
    stored, not the extraction, which is several times the texts; ``keep_extracted`` stores it for
    callers that write many sinks.
    """

    documents: DataFrame
    registry: DataFrame
    existing_tickets: DataFrame | None = None
    existing_incidents: DataFrame | None = None
    existing_contracts: DataFrame | None = None
    method: str = "indel"
    tiers: Sequence[float] = (85, 60)
    keep_extracted: bool = False

    @cached_property
    def extracted(self) -> DataFrame:
        made = staging.extract(self.documents, with_text=True)
        return cut_lineage(made) if self.keep_extracted else made

    @cached_property
    def mentions(self) -> DataFrame:
        # Stored with those that name nobody: a filter would go below what makes the name, and make it twice.
        return staging.customer_mentions(cut_lineage(self.extracted.select("document_id", "arrived_at", "customer_name")))

    @cached_property
    def decisions(self) -> DataFrame:
        names = resolve.distinct_names(self.mentions, "seen_order")
        return cut_lineage(resolve.resolve_names(names, self.registry, self.method, self.tiers))

    @cached_property
    def log(self) -> DataFrame:
        return resolve.resolve_mentions(self.mentions, self.decisions)

    @cached_property
    def staged(self) -> DataFrame:
        return staging.staged_entities(self.extracted)

    @cached_property
    def reviews(self) -> DataFrame:
        return staging.review_queue(staging.low_confidence_items(self.extracted), resolve.ambiguous(self.log))

    def _coded(self, facts: DataFrame) -> DataFrame:
        """Facts with the customer's id for the name; names are few among the facts kept, so they come last."""
        named = facts.withColumnRenamed("customer_code", "customer_name")
        return staging.with_customer(named, self.decisions).select(*facts.columns)

    @cached_property
    def _named(self) -> DataFrame:
        return self.extracted.withColumn("customer_code", F.col("customer_name"))

    @cached_property
    def tickets(self) -> DataFrame:
        return self._coded(staging.ticket_facts(self._named, self.existing_tickets))

    @cached_property
    def incidents(self) -> DataFrame:
        return staging.incident_facts(self.extracted, self.existing_incidents)

    @cached_property
    def contracts(self) -> DataFrame:
        return self._coded(staging.contract_facts(self._named, self.existing_contracts))

    @cached_property
    def feedback(self) -> DataFrame:
        return self._coded(staging.feedback_facts(self._named))

    @cached_property
    def new_customers(self) -> DataFrame:
        return resolve.new_entities(self.decisions)


def document_run(
    documents: DataFrame,
    registry: DataFrame,
    existing_tickets: DataFrame | None = None,
    existing_incidents: DataFrame | None = None,
    existing_contracts: DataFrame | None = None,
    method: str = "indel",
    tiers: Sequence[float] = (85, 60),
    keep_extracted: bool = False,
) -> Run:
    """All outputs of a batch of documents (document_id, domain, arrived_at, text).

    Only names go through resolution; of the facts, feedback alone carries the text.
    """
    return Run(
        documents, registry, existing_tickets, existing_incidents, existing_contracts, method, tiers, keep_extracted
    )
