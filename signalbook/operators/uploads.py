"""Upload intake: allow-list, size limit, and one document per content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv


def extension(name: Column) -> Column:
    """What follows the last dot of a file name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def intake(
    files: DataFrame,
    order: Sequence[str],
    extensions: Sequence[str] = tuple(fv.ALLOWED_EXTENSIONS),
    max_bytes: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per upload (document_id, filename, content, ...): its type, size, hash and what became of it.

    A file whose type is not allowed or that is larger than ``max_bytes`` is refused and not hashed.  Of
    equal contents the first by ``order`` (then document_id) is accepted; the others, and all that
    ``known`` (file_hash, document_id) holds from earlier runs, are duplicates of the stored document.
    A null content is an empty one, a null name has no type.  Only hash, order and ids are shuffled,
    combined before they are, so a content that most uploads share is one row per task.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    kind = F.coalesce(extension(F.col("filename")), F.lit(""))
    # A type that is none of them makes the test false, never null.
    refusal = F.when(~kind.isin(list(extensions)), "file type not allowed")
    if max_bytes is not None:
        refusal = refusal.when(size > max_bytes, "file too large")
    digest = F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")), 256)
    order_by = [c for c in [*order, "document_id"]]
    listed = files.select(
        "document_id",
        "filename",
        kind.alias("file_type"),
        size.alias("file_size_bytes"),
        F.when(refusal.isNull(), digest).alias("file_hash"),
        refusal.alias("reason"),
        F.struct(*order_by).alias("_order"),
    )
    accepted = listed.filter(F.col("file_hash").isNotNull())
    stored = accepted.groupBy("file_hash").agg(F.min_by("document_id", "_order").alias("_first"))
    if known is not None:
        earlier = known.groupBy("file_hash").agg(F.min("document_id").alias("_known"))
        stored = stored.join(earlier, "file_hash", "left")
    else:
        stored = stored.withColumn("_known", F.lit(None).cast(files.schema["document_id"].dataType))
    met = accepted.join(stored, "file_hash").withColumn("_kept", F.coalesce("_known", "_first"))
    new = F.col("_known").isNull() & (F.col("document_id") == F.col("_first"))
    shown = ["document_id", "filename", "file_type", "file_size_bytes", "file_hash"]
    refused = listed.filter(F.col("file_hash").isNull())
    return met.select(
        *shown, F.when(new, "uploaded").otherwise("duplicate").alias("status"), F.col("_kept").alias("stored_as"), "reason"
    ).unionByName(
        refused.select(*shown, F.lit("refused").alias("status"), F.lit(None).cast(met.schema["_kept"].dataType).alias("stored_as"), "reason")
    )


def stored_files(intakes: DataFrame) -> DataFrame:
    """file_hash and document_id of what an intake stored: the ``known`` of the next run."""
    return intakes.filter(F.col("status") == "uploaded").select("file_hash", "document_id")
