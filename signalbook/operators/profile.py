"""Profiling and landing of raw tables and documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.text import word_count
from signalbook.functions.values import half_up
from signalbook.operators.positions import number_rows


def text_pages(
    documents: DataFrame, key: str, text: str = "text", lines_per_page: int = fv.LINES_PER_PAGE
) -> DataFrame:
    """Virtual pages of a fixed number of lines.  Row-local: no shuffle.

    A null text is an empty one: one page with one empty line.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    last = F.floor((F.size("_lines") - 1) / lines_per_page).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), last),
        lambda p: F.struct(
            (p + 1).alias("page_number"),
            F.array_join(
                F.slice(F.col("_lines"), p * lines_per_page + 1, F.lit(lines_per_page)), "\n"
            ).alias("page_text"),
        ),
    )
    return (
        documents.select(F.col(key), body.alias("_text"), lines.alias("_lines"))
        .select(
            key,
            F.size("_lines").alias("line_count"),
            word_count(F.col("_text")).alias("word_count"),
            (last + 1).alias("total_pages"),
            F.inline(pages),
        )
    )


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def rows_to_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    rows_per_page: int = fv.ROWS_PER_PAGE,
    max_pages: int | None = None,
) -> DataFrame:
    """Each row as ``name: value | name: value`` (empty values left out), in pages.

    A page holds a fixed number of rows, so each group collected is bounded.
    """
    shown = [c for c in df.columns if c not in keys]
    parts = [
        F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string")))
        for c in shown
    ]
    placed = number_rows(df, keys, order, chunk, "_row").select(
        *keys,
        (F.floor((F.col("_row") - 1) / rows_per_page) + 1).alias("page_number"),
        "_row",
        F.concat_ws(" | ", *parts).alias("_line"),
    )
    if max_pages is not None:
        placed = placed.filter(F.col("page_number") <= max_pages)
    return placed.groupBy(*keys, "page_number").agg(
        F.count("*").alias("n_rows"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_row", "_line"))), lambda x: x._line),
            "\n",
        ).alias("page_text"),
    )


def column_profile(df: DataFrame, order: Sequence[str], samples: int = 3) -> DataFrame:
    """Per column: type, counts, distinct values and the first samples by ``order``.

    Counts come from one pass.  Distinct values and samples use the unpivoted
    column, where partial counts and a bounded top-k per task keep both small.
    """
    types = dict(df.dtypes)
    columns = df.columns
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count(c).alias(f"_c_{c}") for c in columns]
    ).select(
        "_rows",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.lit(types[c]).alias("dtype"),
                        F.col(f"_c_{c}").alias("non_null_count"),
                    )
                    for c in columns
                ]
            )
        ),
    )
    long = as_strings(df).unpivot([], columns, "column_name", "value")
    distinct = long.groupBy("column_name").agg(F.count_distinct("value").alias("unique_count"))

    def first_values(c: str) -> DataFrame:
        """Top-k of one column: reads only that column and the order key."""
        top = df.filter(F.col(c).isNotNull()).orderBy(*order).limit(samples)
        values = F.transform(
            F.sort_array(F.collect_list(F.struct(*order, F.col(c).cast("string").alias("_value")))),
            lambda x: x._value,
        )
        return top.agg(values.alias("sample_values")).select(
            F.lit(c).alias("column_name"), "sample_values"
        )

    sampled = reduce(DataFrame.unionByName, [first_values(c) for c in columns])
    return (
        counted.join(distinct, "column_name", "left")
        .join(sampled, "column_name", "left")
        .select(
            "column_name",
            "dtype",
            "non_null_count",
            (F.col("_rows") - F.col("non_null_count")).alias("null_count"),
            half_up(
                F.try_divide((F.col("_rows") - F.col("non_null_count")) * 100.0, F.col("_rows")), 2
            ).alias("null_pct"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        )
    )


def dataset_metadata(df: DataFrame) -> DataFrame:
    """Row count, column count, columns and full-row duplicates after the first."""
    groups = df.groupBy(*df.columns).count()
    return groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def raw_records(
    df: DataFrame, document: str, order: Sequence[str], chunk: Column
) -> DataFrame:
    """Each source row as JSON text with its document and row number."""
    payload = [c for c in df.columns if c != document]
    return number_rows(df, [document], order, chunk).select(
        F.col(document).alias("document_id"),
        "row_number",
        F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in payload])).alias("raw_data"),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_by_hash(documents: DataFrame, content: str, arrival: Sequence[str]) -> DataFrame:
    """One row per distinct content: the earliest document and the number of copies.

    Only hash and arrival columns are shuffled, combined before the shuffle, so
    a text with very many copies costs one row per task.
    """
    first = F.min(F.struct(*arrival)).alias("_first")
    return (
        documents.select(content_hash(F.col(content)).alias("content_hash"), *arrival)
        .groupBy("content_hash")
        .agg(first, F.count("*").alias("copies"))
        .select("content_hash", "_first.*", "copies")
    )
