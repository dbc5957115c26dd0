"""Pages from the stored ranges of a list, and topics ranked per scope."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalbook.operators import serving
from signalbook.session import scratch_path


def stored(spark, rows, parts=4):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = scratch_path(spark, "pages")
        df = spark.createDataFrame(rows, "k int, v double")
        order = [F.desc_nulls_last("v"), F.asc("k")]
        serving.store_pages(df, order, path)
        return df, order, path
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("number", [1, 2, 9, 15, 16, 99])
def test_pages_are_those_of_the_sorted_list(spark, number):
    # ties and nulls in the sort value
    df, order, path = stored(spark, [(i, None if i % 5 == 0 else float(i % 7)) for i in range(150)])
    want = [(r.k, r.v, 150) for r in df.orderBy(*order).offset((number - 1) * 10).limit(10).collect()]
    got = serving.page_at(spark, path, number, 10)
    assert [(r.k, r.v, r.total) for r in got.collect()] == want


def test_a_page_opens_one_range_or_two(spark):
    _, _, path = stored(spark, [(i, float(i)) for i in range(400)])
    index = sorted((r.start, r.rows) for r in spark.read.parquet(f"{path}/index").collect())
    assert len(index) > 2 and sum(n for _, n in index) == 400
    for number in (1, 10, 20):
        read = {f.split("_range=")[1].split("/")[0] for f in serving.page_at(spark, path, number, 20).inputFiles()}
        assert 1 <= len(read) <= 2


def test_no_rows(spark):
    _, _, path = stored(spark, [])
    assert serving.page_at(spark, path).collect() == []


def test_top_topics_per_scope(spark):
    at = datetime(2024, 1, 5)
    rows = [(at, "a", ["x", "x", "y"]), (at, "a", ["z", None]), (at, None, ["y", "w"]), (at, "b", []), (at, "b", None)]
    records = spark.createDataFrame(rows, "at timestamp, dim string, topics array<string>").withColumn("sentiment", F.lit("neutral")).withColumn("sentiment_score", F.lit(0.5))
    tops = serving.top_topics(records, "at", k=2, scopes=["dim"])
    got = {(r.scope, r.dim, r.rank): (r.topic, r.mentions) for r in tops.collect()}
    assert got == {
        ("all", None, 1): ("x", 2), ("all", None, 2): ("y", 2), ("dim", "a", 1): ("x", 2), ("dim", "a", 2): ("y", 1),
        ("dim", None, 1): ("w", 1), ("dim", None, 2): ("y", 1),
    }
    rolled = serving.with_top_topics(serving.sentiment_rollup(records, "at", scopes=["dim"]), tops, ["dim"])
    assert {(r.scope, r.dim): r.top_topics for r in rolled.collect()} == {
        ("all", None): ["x", "y"], ("dim", "a"): ["x", "y"], ("dim", None): ["w", "y"], ("dim", "b"): [],
    }
