"""The best partner of a name, against comparing every pair, without listing segments or making names twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbook.operators import resolve, similar
from signalbook.sources import texts
from tests.test_resolve import all_scores, company_names, mutate


def sort(name):
    return " ".join(sorted(name.split()))


@pytest.mark.parametrize("method", ["indel", "levenshtein"])
def test_best_partner_is_that_of_all_pairs(spark, monkeypatch, method):
    monkeypatch.setattr(similar, "segment_candidates", lambda *_: pytest.fail("segments are listed"))
    monkeypatch.setattr(similar, "BLOCK_NAMES", 64)
    rng = random.Random(8)
    known = company_names(rng, 300)
    turned = [" ".join(reversed(k.split())) for k in known[:20]]
    mentions = sorted({mutate(rng, rng.choice(known)) for _ in range(150)} | set(company_names(rng, 60)) | set(turned))
    ids = [f"S{(i * 7) % 300 // 2:04}" for i in range(300)]
    registry = spark.createDataFrame([("service", c, k, k) for c, k in zip(ids, known)], "entity_type string, canonical_id string, canonical_name string, known string")
    asked = spark.createDataFrame([("service", m) for m in mentions] * 2 + [("other", known[0])], "entity_type string, norm string")
    score = all_scores([sort(m) for m in mentions], [sort(k) for k in known], method)
    want = {}
    for m, row in zip(mentions, score):
        if row.max() >= 60 - 1e-6:
            best = min((c, k) for c, k, s in zip(ids, known, row) if s > row.max() - 1e-6)
            want[m] = (*best, round(float(row.max()), 4))
    rows = resolve.best_fuzzy(asked, registry, method).collect()
    assert len(rows) == len(want) and {r.entity_type for r in rows} == {"service"}
    assert {r.norm: (r.canonical_id, r.canonical_name, round(r.score, 4)) for r in rows} == want


def test_bits_lose_no_pair_of_long_names_in_many_letters():
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in (*range(97, 123), *range(0x4E00, 0x4E00 + 300))]
    known = ["".join(rng.choice(letters, rng.integers(60, 140))) for _ in range(60)]
    names = ["".join(c for c in k if rng.random() > 0.3) + "".join(rng.choice(letters, 9)) for k in known]
    left, right = np.array(names), np.array(known)
    i, j = (g.ravel() for g in np.meshgrid(range(60), range(60), indexing="ij"))
    common = similar.subsequence_lengths(left, right, i, j)
    for method in ("indel", "levenshtein"):
        size, other = np.char.str_len(left)[i], np.char.str_len(right)[j]
        reach = common >= similar._need(size, other, 0.6, method)
        assert reach.sum() >= 40
        assert set(zip(i[reach], j[reach])) <= set(zip(*similar.block_candidates(left, right, 60, method)))


def test_names_of_mentions_are_made_once(spark):
    class Made:
        pass

    tables = Made()
    tables.spark = spark
    tables.lineitem = spark.range(40).select(
        *[F.col("id").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    )
    named = resolve.distinct_names(texts.service_mentions(tables), "seen_order")
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5(") <= 3, "two words and the one of the new names"
    empty = spark.createDataFrame([("a", None, 1), ("a", "x", 3), ("a", "x", 2), (None, "x", 5)], "entity_type string, raw_value string, at int")
    assert sorted(map(tuple, resolve.distinct_names(empty, "at").collect()), key=str) == [("a", "x", 2, 2), (None, "x", 5, 1)]
