"""File sources and sinks: CSV, text, JSON, Parquet and raw uploads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalbook import fixed_values as fv


def null_tokens(value: Column, tokens: Sequence[str] = fv.NA_TOKENS) -> Column:
    return F.when(~value.isin(list(tokens)), value)


def read_csv(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = fv.NA_TOKENS, multi_line: bool = False
) -> DataFrame:
    """Header row, every column a string, missing-value words as null.

    Files are split between tasks.  Quoted line breaks need ``multi_line``, and then a file is one task.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return raw.select(*[null_tokens(F.col(c), na_tokens).alias(c) for c in raw.columns])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON lines; without a schema the data is read once more to find it, all values as strings."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, primitivesAsString=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv,
    "txt": read_text,
    "log": read_text,
    "md": read_text,
    "json": read_json,
    "parquet": read_parquet,
}


def read_by_format(
    spark: SparkSession,
    path: str,
    extension: str,
    readers: dict[str, Callable[[SparkSession, str], DataFrame]] = READERS,
) -> DataFrame:
    """The reader registered for the extension."""
    reader = readers.get(extension.lower().lstrip("."))
    if reader is None:
        raise ValueError(f"no reader for file type: {extension}")
    return reader(spark, path)


def read_uploads(
    spark: SparkSession,
    path: str,
    extensions: Sequence[str] = tuple(READERS),
    max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused files: those with a reader, and of any size unless there is a limit.

    Names and sizes are tested before content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = files.withColumn(
        "file_type", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    )
    allowed = F.col("file_type").isin(list(extensions))
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    accepted = listed.filter(allowed & small).withColumn("file_hash", F.sha2("content", 256))
    refused = listed.filter(~(allowed & small)).select(
        "path",
        "length",
        F.when(~allowed, "file type not allowed").otherwise("file too large").alias("reason"),
    )
    return accepted, refused


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts, each with a header row."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
