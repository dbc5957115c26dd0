"""Sides that grow with the input are exchanged, however small their compressed files are."""

import pytest
from pyspark.sql import functions as F

from signalbook.operators import resolve, staging
from signalbook.operators.similar import segment_candidates, similar_names


@pytest.fixture
def stored(spark, tmp_path):
    """Names, registry, known names and decisions as stored tables of a few KB."""
    names = spark.range(200).select(
        F.lit("customer").alias("entity_type"),
        F.concat(F.lit("Name "), F.col("id") % 90).alias("raw_value"),
        F.concat(F.lit("name "), F.col("id") % 90).alias("norm"),
        F.concat(F.lit("C"), "id").alias("document_id"),
    )
    registry = spark.range(100).select(
        F.lit("customer").alias("entity_type"),
        F.concat(F.lit("C"), "id").alias("canonical_id"),
        F.concat(F.lit("Name "), "id").alias("name"),
        F.array(F.concat(F.lit("n"), "id")).alias("aliases"),
    )
    out = {}
    for name, rows in {"names": names, "registry": registry, "known": resolve.name_table(registry)}.items():
        path = str(tmp_path / name)
        rows.write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_names_and_decisions_are_never_broadcast(stored):
    names, registry, known = stored["names"], stored["registry"], stored["known"]
    decisions = resolve.resolve_exact(names, registry)
    found = {
        "exact": decisions,
        "normalised": resolve.resolve_normalized(names, known),
        "log": resolve.resolve_mentions(names, registry.withColumnRenamed("name", "raw_value")),
        "codes": staging.with_customer(names.withColumnRenamed("raw_value", "customer_name"), registry.withColumnRenamed("name", "raw_value")),
    }
    assert {k: joins(v) for k, v in found.items()} == {k: (0, 1) for k in found}
    strict = similar_names(names, known, 85)
    assert joins(strict) == (0, 3)
    assert strict.where("score = 100").select("norm").distinct().count() == 90


def test_costly_rows_are_dealt_out(spark, tmp_path):
    from signalbook.sources import star

    path = str(tmp_path / "rows")
    spark.range(50).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert star.spread(rows).rdd.getNumPartitions() == 1
    assert star.spread(rows, costly=True).rdd.getNumPartitions() == parts
    assert sorted(r.id for r in star.spread(rows, costly=True).collect()) == list(range(50))


def test_names_are_dealt_out_before_their_segments(spark, stored):
    left = stored["names"].select("entity_type", F.col("norm").alias("_a")).distinct()
    right = stored["known"].select("entity_type", F.col("known").alias("_b")).distinct()
    found = segment_candidates(left, right, 85, "indel")
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2
    assert found.where("_a = _b").count() == 90
