"""Secret scans over content-addressed blobs with an incremental ledger.

Every version of a text is addressed by the SHA-256 of its bytes.  The ledger, a Parquet folder in a
shared store, has one row per blob and scan: which rule versions were run and what they found.  A run
scans each blob once, however many paths and versions hold it, and only with the rule versions that
the ledger lacks for it; the findings are then joined back to every path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.llm.common import by_value, path_exists, text_of


class Rule(NamedTuple):
    """A pattern whose matches count if the given group is long enough."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    #: A match contains one of these (compared in lower case); texts without are skipped.
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which their kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        any_case=True,
        hints=("passw", "secret", "token", "api"),
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, hints=("akia",)),
    # A run of 32 or more is the same match as a run of any length that is then held to 32.
    Rule("hex", 1, r"[0-9a-f]{32,}", least=32),
)
#: What this scanner finds beyond the base rules.
ADDED_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", hints=("private key",)),
    Rule("web_token", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("prefixed", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", hints=("gh", "xox", "sk_live_")),
)
RULES = BASE_RULES + ADDED_RULES

LEDGER = "blob string, rules array<string>, kinds array<string>, starts array<long>, ends array<long>"


def find_secrets(text: str, rules: Sequence[Rule]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every match in code points, end exclusive, rule by rule."""
    found = []
    lowered = text.lower()
    for rule in rules:
        if rule.hints and not any(hint in lowered for hint in rule.hints):
            continue
        pattern = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))
        for match in pattern.finditer(text):
            start, end = match.span(rule.group)
            if end - start >= rule.least:
                found.append((match.start(), match.end(), rule.kind))
    return found


def _scanner(rules: Sequence[Rule]):
    by_name = {rule.name: rule for rule in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for blob, text, todo in zip(batch["blob"], batch["text"], batch["todo"]):
                found = find_secrets(text, [by_name[name] for name in todo])
                starts, ends, kinds = zip(*found) if found else ((), (), ())
                rows.append((blob, list(todo), list(kinds), list(starts), list(ends)))
            yield pd.DataFrame(rows, columns=["blob", "rules", "kinds", "starts", "ends"])

    return scan


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_new_blobs(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
    """Scan what the ledger lacks and append it there; the append appears when it is complete."""
    spark = versions.sparkSession
    names = F.array(*[F.lit(rule.name) for rule in rules])
    text = text_of(text_col)
    held = versions.select(blob_id(text).alias("blob"), text.alias("text"))
    if path_exists(spark, ledger):
        known = (
            spark.read.schema(LEDGER).parquet(ledger).select("blob", F.explode("rules").alias("rule"))
            .groupBy("blob").agg(F.collect_set("rule").alias("known"))
        )
        todo = (
            held.select("blob").distinct().join(known, "blob", "left")
            .select("blob", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0)
        )
        held = held.join(todo.select("blob"), "blob", "left_semi")
        blobs = held.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    else:
        blobs = held.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", names)
    blobs.select("blob", "text", "todo").mapInPandas(_scanner(rules), LEDGER).write.mode("append").parquet(ledger)


def blob_findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob and its spans (start, place of the kind, end, kind) in order, of the given rule versions.

    A blob that was scanned twice with the same rule version has its findings once.
    """
    places = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule.kind, i)])
    current = F.array(*[F.lit(rule.name) for rule in rules])
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    ran = F.transform(F.array_intersect("rules", current), lambda name: F.get(kinds, (F.array_position(current, name) - 1).cast("int")))
    spans = F.filter(F.arrays_zip("starts", "ends", "kinds"), lambda s: F.array_contains(ran, s["kinds"]))
    return (
        ledger.select("blob", spans.alias("found"))
        .where(F.size("found") > 0)
        .select("blob", F.transform("found", lambda s: F.struct(s["starts"].alias("start"), places[s["kinds"]].alias("place"), s["ends"].alias("end"), s["kinds"].alias("kind"))).alias("found"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("spans"))
    )


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``versions`` with ``blob`` and ``spans``, after scanning what is new.

    A null text is the empty text; an empty table leaves the ledger with no new rows.  Texts are
    scanned whole.  Columns named blob or spans in the input are replaced.
    """
    scan_new_blobs(versions, ledger, rules, text_col)
    found = blob_findings(versions.sparkSession.read.schema(LEDGER).parquet(ledger), rules)
    keep = [c for c in versions.columns if c.lower() not in ("blob", "spans")]
    rows = versions.withColumn("blob", blob_id(text_of(text_col))).select(*[F.col(f"`{c}`") for c in keep], "blob")
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return rows.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none)).select(*[F.col(f"`{c}`") for c in keep], "blob", "spans")


def span_list(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


by_value(__name__)
