"""Numbering rows inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalbook.operators.shape import join_keys


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    name: str = "row_number",
) -> DataFrame:
    """Add the 1-based position of each row in its group.

    One group may hold a third of all rows, so a group is never sorted in one
    task.  ``chunk`` cuts it into consecutive pieces: it must never fall while
    ``order`` rises (a day of a timestamp, a range of an id).  Each piece is
    numbered alone and shifted by the number of rows in the pieces before it.
    Null keys form a group and a null chunk is the first piece.
    """
    cut = df.withColumn("_chunk", chunk)
    on = [*keys, "_chunk"]
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*on)
        .agg(F.count("*").alias("_size"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*on).orderBy(*order)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .transform(join_keys, shift, on)
        .withColumn(name, F.col("_shift") + F.col("_inside"))
        .drop("_chunk", "_inside", "_shift")
    )
