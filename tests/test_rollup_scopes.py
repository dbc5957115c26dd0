"""Each dimension of the sentiment rollup is an aggregate of its own over rows stored once."""

from collections import Counter

from pyspark.sql import functions as F

from signalbook.operators import serving

ROWS = [(1, "a", "x", "positive"), (1, "a", None, "negative"), (2, None, "x", "neutral"), (2, None, None, None), (2, "b", "x", "positive")]


def test_dimensions_are_grouped_apart(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame(ROWS, "month int, one string, two string, sentiment string")
    rows.select(F.make_timestamp_ntz(F.lit(2024), "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"), "one", "two", "sentiment", F.lit(0.5).alias("sentiment_score")).write.parquet(path)
    rolled = serving.sentiment_rollup(spark.read.parquet(path), scopes=["one", "two"])
    got = {(r.period_start.month, r.scope, r.one, r.two): r.total_records for r in rolled.collect()}
    want = Counter()
    for month, one, two, _ in ROWS:
        want.update([(month, "all", None, None), (month, "one", one, None), (month, "two", None, two)])
    assert got == dict(want)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and path not in plan
