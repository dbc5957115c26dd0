"""Exact values at ranks, for every shape of data, also where the sketch is wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from signalbook.operators import series

RNG = random.Random(3)
GROUPS = {
    "one": [5.0],
    "two": [2.0, 1.0],
    "ties": [1.0] * 500 + [2.0] * 3,
    "normal": [RNG.gauss(0, 1) for _ in range(3000)],
    "heavy": [math.copysign(10 ** RNG.uniform(-300, 300), RNG.random() - 0.5) for _ in range(2000)],
    "close": [1.0 + i * 2.0**-52 for i in range(700)],
    "edges": [float("-inf"), -1.7e308, -5e-324, 0.0, 5e-324, 1.7e308, float("inf"), float("inf")],
    None: [float(i % 37) for i in range(400)],
}


def rows(spark):
    held = [(g, v) for g, values in GROUPS.items() for v in values] + [("none", None), ("one", None)]
    return spark.createDataFrame(held, "g string, value double").repartition(5)


def plain(values):
    s, n = sorted(values), len(values)
    return s[n // 4], s[3 * n // 4], (s[(n - 1) // 2] + s[n // 2]) / 2


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("accuracy", [10000, 10])
def test_quartiles_are_those_of_the_sorted_group(spark, accuracy, monkeypatch):
    exact = series.values_at_ranks
    monkeypatch.setattr(series, "values_at_ranks", lambda *a: exact(*a, accuracy=accuracy))
    got = {r.g: (r.q1, r.q3, r.median) for r in series.quartiles(rows(spark), ["g"]).collect()}
    want = {g: plain(v) for g, v in GROUPS.items()}
    assert set(got) == set(want)
    for g in want:
        assert all(map(same, got[g], want[g])), (g, got[g], want[g])


@pytest.mark.parametrize("wrong", [(0.9, 1.0), (0.0, 0.1), (0.4, 0.41)])
def test_a_range_that_misses_the_rank_is_put_right(spark, wrong, monkeypatch):
    # A sketch that answers other shares than it was asked for: its ranges hold none of the ranks.
    lie = F.percentile_approx
    monkeypatch.setattr(series.F, "percentile_approx", lambda c, shares, a: lie(c, [wrong[i % 2] for i in range(len(shares))], a))
    got = {r.g: (r.q1, r.q3, r.median) for r in series.quartiles(rows(spark), ["g"]).collect()}
    for g, v in GROUPS.items():
        assert all(map(same, got[g], plain(v))), g


def test_no_rows(spark):
    assert series.quartiles(rows(spark).where("false"), ["g"]).collect() == []
