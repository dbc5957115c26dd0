"""Review queries read the extraction once stored; none extracts again for each of its inputs."""

import pytest
from pyspark.sql import functions as F

from signalbook.plans import catalog


@pytest.fixture
def folder(spark, tmp_path):
    orders = spark.range(60).select(
        F.col("id").alias("o_orderkey"),
        (F.col("id") % 9).alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        (F.col("id") * 10.5).alias("o_totalprice"),
        F.lit("1997-03-05 00:00:00").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("5-LOW").alias("o_orderpriority"),
    )
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["apply_review_actions", "rejected_review_actions", "review_list"])
def test_orders_are_not_read_again(spark, folder, name):
    found = catalog.build(name)(spark, folder)
    assert not [f for f in found.inputFiles() if "orders.parquet" in f]
    assert found.count() > 0
