"""What lies on disk grows with the rows: no pairs of blocks are exchanged, no extraction is stored for one sink."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from signalbook.operators import similar
from signalbook.plans import intake
from tests.test_resolve import lcs


def test_a_task_gives_one_partner_a_name():
    rng = np.random.default_rng(6)
    made = lambda n: ["".join(rng.choice(list("abcdef"), rng.integers(4, 9))) for _ in range(n)]
    left, right = sorted(set(made(30))), sorted(set(made(80)))
    rank = rng.permutation(len(right))
    kind = pa.list_(pa.struct([("_b", pa.string()), ("_rank", pa.int64())]))
    blocks = [[{"_b": right[k], "_rank": int(rank[k])} for k in range(at, len(right), 4)] for at in range(4)]
    rows = {"entity_type": pa.array(["s"] * 4), "lefts": pa.array([left] * 4), "rights": pa.array(blocks, kind)}
    batch = pa.RecordBatch.from_pydict(rows)
    got = [r for out in similar._best_of_blocks(60)(iter([batch.slice(0, 3), batch.slice(3)])) for r in out.to_pylist()]
    score = {a: [200.0 * lcs(a, b) / (len(a) + len(b)) for b in right] for a in left}
    want = {a: min((-round(s, 6), int(k)) for s, k in zip(row, rank)) for a, row in score.items() if max(row) >= 60 - 1e-9}
    assert len(got) == len(want) > 20
    assert {r["_a"]: (-round(200.0 * r["_common"] / r["_total"], 6), r["_rank"]) for r in got} == want


def test_pairs_of_blocks_are_not_exchanged(spark):
    known = spark.range(40).select(F.lit("s").alias("entity_type"), F.concat(F.lit("name "), "id").alias("known"), "id")
    knows = similar.ranked(known.select("*", F.col("known").alias("canonical_id"), F.col("known").alias("canonical_name")))
    names = known.select("entity_type", F.concat("id", F.lit("x name")).alias("_a"))
    for method in ("indel", "levenshtein"):
        met = similar._met(similar._blocks(names, "_a", "lefts"), similar._blocks(knows, "_b", "rights"), 60, method)
        top = met._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")
        assert len(top) == 2 and "Exchange" not in top[0]
    found = similar.best_in_blocks(names, knows, 60, "indel").groupBy("_a").count()
    assert found.count() == 40


def test_one_letter_less(spark):
    known = [("s", "C2", "abcd"), ("s", "C1", "abed"), ("s", "C0", "abd e"), ("t", "C0", "abcd")]
    knows = similar.ranked(spark.createDataFrame([(*k, k[2]) for k in known], "entity_type string, canonical_id string, known string, canonical_name string"))
    names = spark.createDataFrame([("s", "abd"), ("s", "xyz"), ("s", "ab")], "entity_type string, _a string")
    for method, score in (("indel", round(600 / 7, 6)), ("levenshtein", 75.0)):
        rows = similar.one_letter_less(names, knows, 60, method).join(knows, ["entity_type", "_rank"])
        assert sorted((r._a, r.canonical_id, r.score) for r in rows.collect()) == [("abd", "C1", score), ("abd", "C2", score)]


LONG = "Customer: Acme Corp, " + "the portal is slow and broken. " * 40
DOCUMENTS = [("D1", "document_contract", 1, LONG + "Contract CN-12/A"), ("D2", "document_contract", 2, "no number"), ("D3", None, 3, None)]


def run(spark, **more):
    docs = spark.createDataFrame(DOCUMENTS, "document_id string, domain string, arrived_at int, text string")
    registry = spark.createDataFrame([("customer", "C1", "Acme Corp", [])], "entity_type string, canonical_id string, name string, aliases array<string>")
    return intake.document_run(docs, registry, **more)


def test_one_sink_stores_names_only(spark, monkeypatch):
    stored = []
    cut = intake.cut_lineage
    monkeypatch.setattr(intake, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    made = run(spark)
    assert [(r.contract_number, r.customer_code) for r in made.contracts.collect()] == [("CN-12/A", "C1")]
    assert made.log.count() == 1 and made.new_customers.count() == 0
    assert stored[0] == ["document_id", "arrived_at", "customer_name"] and len(stored) == 2
    assert not any("fields" in columns for columns in stored)


def test_feedback_has_the_whole_text(spark):
    rows = {r.document_id: r for r in run(spark).feedback.collect()}
    assert {k: r.raw_text for k, r in rows.items()} == {d[0]: d[3] for d in DOCUMENTS}
    assert [rows[d].customer_code for d in ("D1", "D2", "D3")] == ["C1", None, None]
