"""Putting one-row results side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys of which any may be null: null keys meet null keys.  Keys come from the left."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    on = reduce(lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"_right_{key}"]) for key in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{key}" for key in keys])


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row from several one-row frames with different columns, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
