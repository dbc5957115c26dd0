"""A look at the first character changes no match."""

import random

import pytest
from pyspark.sql import functions as F

from signalbook.functions import extract as ex


@pytest.mark.parametrize("pattern", ex.BEGINNINGS)
def test_same_matches_with_a_look_at_the_first_character(spark, pattern):
    assert ex._looked(pattern) != pattern
    rng = random.Random(4)
    bits = ["Jan", "sEPt", "ſep", "Dec", "mar.", " ", " ", "\t", "1", "12", ",", "2020", "٣", "$", "€", "£", "EUR", "usd", "INR", ".50", "k", "M", "million", "x", "/", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)] + ["Jan 5, 2020 and ſep 12 2021", "$ 1,000.50 k"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for flags in ("", "(?U)"):
        plain, looked = (F.regexp_extract_all("t", F.lit(flags + p), F.lit(0)) for p in (pattern, ex._looked(pattern)))
        counted = rows.select(F.sum(F.size(plain)).alias("n"), F.count_if(plain != looked).alias("other")).first()
        assert counted.n > 0 and counted.other == 0
