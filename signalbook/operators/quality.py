"""Data quality of a table of string columns: five scores, issues and field statistics.

All row-level checks of a table are generated from its schema as columns and
counted in one pass; only the duplicate check needs a shuffle, on the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.values import blank_to_null, half_up
from signalbook.operators.shape import side_by_side

START_COLUMNS = ["start_date", "created_date"]
END_COLUMNS = ["end_date", "resolved_date"]
AGE_COLUMNS = ["created_date", "updated_at", "occurred_at"]


def critical_fields(record_type: str, fields: Sequence[str] | None = None) -> list[str]:
    return list(fields) if fields is not None else fv.CRITICAL_FIELDS.get(record_type, [])


def is_missing(df: DataFrame, field: str) -> Column:
    """Null or empty.  A column that is not there is missing."""
    if field not in df.columns:
        return F.lit(True)
    value = F.col(field)
    return value.isNull() | (value.cast("string") == "")


def rule_for(column: str) -> tuple[str, str] | None:
    """The first rule whose name is part of the column name."""
    for key, rule in fv.VALIDITY_RULES.items():
        if key in column.lower():
            return rule
    return None


def is_invalid(column: str) -> Column:
    pattern, _ = rule_for(column)
    value = F.col(column).cast("string")
    return value.isNotNull() & ~value.rlike("(?iU)^(?:" + pattern + ")")


def ruled_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if rule_for(c)]


def duplicate_key(df: DataFrame, width: int = 3) -> Column:
    """The first columns' non-empty values joined by a bar."""
    return F.concat_ws("|", *[blank_to_null(F.col(c).cast("string")) for c in df.columns[:width]])


def _first_filled(df: DataFrame, names: Sequence[str]) -> Column:
    present = [blank_to_null(F.col(c).cast("string")) for c in names if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def wrong_order(df: DataFrame) -> Column:
    """Start after end, compared as text."""
    start, end = _first_filled(df, START_COLUMNS), _first_filled(df, END_COLUMNS)
    return F.coalesce(start > end, F.lit(False))


def is_stale(df: DataFrame, as_of: Column, days: int = fv.STALE_AFTER_DAYS) -> Column:
    """First filled date column holds an ISO date or time older than the limit."""
    head = F.substring(_first_filled(df, AGE_COLUMNS), 1, 19)
    at = F.coalesce(
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    )
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)
    return F.coalesce(age > days, F.lit(False))


def row_counts(
    df: DataFrame, record_type: str, as_of: Column, fields: Sequence[str] | None = None
) -> DataFrame:
    """All row-level counters in one pass over the table."""
    critical = critical_fields(record_type, fields)
    ruled = ruled_columns(df)
    zero = F.lit(0)
    bad = [is_invalid(c).cast("int") for c in ruled]
    missing = [is_missing(df, c).cast("int") for c in critical]
    checked = df.select(
        reduce(add, bad, zero).alias("_bad"),
        reduce(add, missing, zero).alias("_missing"),
        wrong_order(df).alias("_order"),
        is_stale(df, as_of).alias("_stale"),
    )
    return checked.agg(
        F.count("*").alias("total_records"),
        F.coalesce(F.sum("_missing"), zero).alias("missing_critical_fields"),
        F.coalesce(F.sum("_bad"), zero).alias("invalid_values"),
        F.count_if(F.col("_bad") > 0).alias("invalid_records"),
        F.count_if("_order").alias("order_errors"),
        F.count_if("_stale").alias("stale_records"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows after the first of each key; counted per key before the shuffle."""
    key = duplicate_key(df)
    groups = df.select(key.alias("_key")).filter(F.col("_key") != "").groupBy("_key").count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_records"))


def quality_report(
    df: DataFrame,
    dataset_name: str,
    record_type: str,
    as_of: Column,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One row: counts, the five scores and the weighted overall score."""
    counts = side_by_side(row_counts(df, record_type, as_of, fields), duplicate_count(df))
    n_critical = max(len(critical_fields(record_type, fields)), 1)
    return _scores(counts, F.lit(n_critical), len(df.columns)).select(
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(record_type).alias("record_type"),
        as_of.alias("report_date"),
        *REPORT,
    )


REPORT = [
    "overall_score", *[f"{part}_score" for part in fv.QUALITY_WEIGHTS], "total_records", "valid_records",
    "invalid_records", "duplicate_records", "missing_critical_fields", "records_requiring_review",
]


def _scores(counts: DataFrame, n_critical: Column, n_columns: int) -> DataFrame:
    """The columns of ``counts`` with the five scores, the weighted one and the derived counts."""
    total = F.col("total_records")

    def score(bad: str, per: Column) -> Column:
        share = F.try_divide(F.col(bad) * 100.0, per)
        return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - share))

    scored = counts.select(
        "*",
        score("missing_critical_fields", total * n_critical).alias("completeness"),
        score("invalid_values", total * max(n_columns, 1)).alias("validity"),
        score("duplicate_records", total).alias("uniqueness"),
        score("order_errors", total).alias("consistency"),
        score("stale_records", total).alias("timeliness"),
    )
    overall = sum(F.col(part) * weight for part, weight in fv.QUALITY_WEIGHTS.items())
    return scored.select(
        "*",
        half_up(overall, 1).alias("overall_score"),
        *[half_up(F.col(part), 1).alias(f"{part}_score") for part in fv.QUALITY_WEIGHTS],
        (total - F.col("invalid_records")).alias("valid_records"),
        F.least(total, F.col("invalid_records") + F.col("duplicate_records")).alias("records_requiring_review"),
    )


def record_type_of(domain: Column) -> Column:
    """The record type whose critical fields a domain's records are held to."""
    return F.replace(F.replace(domain, F.lit("_intelligence"), F.lit("")), F.lit("it_"), F.lit(""))


def document_reports(
    df: DataFrame, as_of: Column, document: str = "document_id", dataset: str = "dataset_name", domain: str = "domain"
) -> DataFrame:
    """One quality report per document from the records of all documents together.

    The record type follows from the document's domain; a type without critical fields misses none.
    The labels are not checked themselves.  Duplicates count inside a document.  One pass: records are
    first folded by document and key, so that a document with most of the records, or one key that most
    of them share, weighs one row per task; these are then summed by document.
    """
    labels = [document, dataset, domain]
    checked = df.drop(*labels)
    kind = F.coalesce(record_type_of(F.col(domain)), F.lit(""))
    zero = F.lit(0)
    bad = reduce(add, [is_invalid(c).cast("int") for c in ruled_columns(checked)], zero)
    missing, n_critical = zero, F.lit(1)
    for name in fv.CRITICAL_FIELDS:
        fields = critical_fields(name)
        lost = reduce(add, [is_missing(checked, f).cast("int") for f in fields], zero)
        missing = F.when(kind == name, lost).otherwise(missing)
        n_critical = F.when(F.col("record_type") == name, max(len(fields), 1)).otherwise(n_critical)
    rows = df.select(
        *labels,
        kind.alias("record_type"),
        duplicate_key(checked).alias("_key"),
        bad.alias("_bad"),
        missing.alias("_missing"),
        wrong_order(checked).alias("_order"),
        is_stale(checked, as_of).alias("_stale"),
    )
    total = {
        "total_records": F.count(F.lit(1)),
        "missing_critical_fields": F.sum("_missing"),
        "invalid_values": F.sum("_bad"),
        "invalid_records": F.count_if(F.col("_bad") > 0),
        "order_errors": F.count_if("_order"),
        "stale_records": F.count_if("_stale"),
    }
    by = [*labels, "record_type"]
    keyed = rows.groupBy(*by, "_key").agg(*[made.alias(name) for name, made in total.items()])
    again = F.when(F.col("_key") != "", F.col("total_records") - 1).otherwise(0)
    counts = keyed.withColumn("duplicate_records", again).groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in [*total, "duplicate_records"]]
    )
    return _scores(counts, n_critical, len(checked.columns)).select(*by, as_of.alias("report_date"), *REPORT)


def missing_by_field(
    df: DataFrame, record_type: str, fields: Sequence[str] | None = None
) -> DataFrame:
    """Missing count of every critical field: one pass, then one row per field."""
    critical = critical_fields(record_type, fields)
    counted = df.agg(
        F.count("*").alias("_total"),
        *[F.count_if(is_missing(df, f)).alias(f"_m_{f}") for f in critical],
    )
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"_m_{f}").alias("missing")) for f in critical]
    )
    return counted.select("_total", F.inline(entries)).select(
        "field",
        F.col("missing").alias("affected_records"),
        half_up(F.try_divide(F.col("missing") * 100.0, F.col("_total")), 1).alias("pct"),
    )


def quality_issues(
    df: DataFrame,
    record_type: str,
    row_id: str,
    fields: Sequence[str] | None = None,
    keep: int | None = None,
) -> DataFrame:
    """Every issue as a row; ``keep`` limits it to a report of the first ones by kind and row.

    ``row_id`` only labels rows, it is not checked itself.
    """
    checked = df.drop(row_id)
    text = F.lit(None).cast("string")
    count = F.lit(None).cast("bigint")
    missing = (
        missing_by_field(checked, record_type, fields)
        .filter(F.col("affected_records") > 0)
        .select(
            F.lit("missing_critical_field").alias("kind"),
            text.alias("row_id"),
            "field",
            text.alias("value"),
            text.alias("message"),
            "affected_records",
        )
    )
    bad = F.array(
        *[
            F.struct(
                is_invalid(c).alias("bad"),
                F.lit(c).alias("field"),
                F.col(c).cast("string").alias("value"),
                F.lit(rule_for(c)[1]).alias("message"),
            )
            for c in ruled_columns(checked)
        ]
    )
    label = F.col(row_id).cast("string").alias("row_id")
    invalid = (
        df.select(label, F.explode(F.filter(bad, lambda b: b.bad)).alias("b"))
        .select(
            F.lit("invalid_value").alias("kind"),
            "row_id",
            "b.field",
            "b.value",
            "b.message",
            count.alias("affected_records"),
        )
    )
    key = duplicate_key(checked)
    duplicate = (
        df.select(key.alias("_key"))
        .filter(F.col("_key") != "")
        .groupBy("_key")
        .count()
        .filter(F.col("count") > 1)
        .select(
            F.lit("duplicate_record").alias("kind"),
            text.alias("row_id"),
            text.alias("field"),
            F.col("_key").alias("value"),
            text.alias("message"),
            (F.col("count") - 1).alias("affected_records"),
        )
    )
    order = df.filter(wrong_order(checked)).select(
        F.lit("date_ordering").alias("kind"),
        label,
        text.alias("field"),
        text.alias("value"),
        F.concat(
            F.lit("start_date > end_date: "),
            _first_filled(checked, START_COLUMNS),
            F.lit(" > "),
            _first_filled(checked, END_COLUMNS),
        ).alias("message"),
        count.alias("affected_records"),
    )
    issues = missing.unionByName(invalid).unionByName(duplicate).unionByName(order)
    if keep is None:
        return issues
    return issues.orderBy("kind", "row_id", "field", "value").limit(keep)


def field_stats(df: DataFrame) -> DataFrame:
    """Null count, share and distinct filled values of every column."""
    values = [F.col(c).cast("string").alias(c) for c in df.columns]
    long = df.select(*values).unpivot([], df.columns, "field_name", "value")
    filled = blank_to_null(F.col("value"))
    return long.groupBy("field_name").agg(
        F.count("*").alias("total_count"),
        F.count_if(filled.isNull()).alias("null_count"),
        half_up(F.count_if(filled.isNull()) * 100.0 / F.count("*"), 1).alias("null_pct"),
        F.count_distinct(filled).alias("unique_count"),
    )


def quality_summary(reports: DataFrame) -> DataFrame:
    """Averages and totals over stored reports; 0 when there are none."""
    mean = lambda c: half_up(F.coalesce(F.avg(c), F.lit(0.0)), 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return reports.agg(
        mean("overall_score").alias("avg_overall_score"),
        mean("completeness_score").alias("avg_completeness_score"),
        mean("validity_score").alias("avg_validity_score"),
        total("total_records").alias("total_records_assessed"),
        total("invalid_records").alias("total_invalid_records"),
        total("duplicate_records").alias("total_duplicate_records"),
    )
