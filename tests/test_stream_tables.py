"""Streams read a table that is one file and a table that is a folder of files alike."""

import pytest
from pyspark.sql import functions as F

from signalbook.plans import catalog


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("text "), F.col("id") % 7)).alias("text"),
        F.lit("en").alias("lang"),
        F.lit("web").alias("source"),
        F.lit(6).alias("n_chars"),
    )
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_a_folder_of_files_is_streamed(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hashes = {r[0] for r in docs.select(F.sha2("text", 256)).distinct().collect()}
    found = [r.content_hash for r in catalog.build("stream_dedup_by_hash")(spark, folder).collect()]
    assert len(found) == len(hashes) and set(found) == hashes
    intake = catalog.build("stream_intake")(spark, folder).collect()
    assert {r.content_hash for r in intake} == hashes
    assert sum(r.copies + 1 for r in intake) == 40
