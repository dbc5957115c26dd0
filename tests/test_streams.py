"""A stream over several files gives the batch result, and a replay adds nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from signalbook.operators import series, staging
from signalbook.sources import texts
from signalbook.sources.star import Tables
from signalbook.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
DOCS = "id long, text string, arrived_at timestamp"


def test_fact_load_in_batches_equals_batch(spark, tmp_path):
    docs = texts.ticket_texts(Tables(spark, FOLDER)).filter("domain = 'it_operations'")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs.repartitionByRange(4, "arrived_at", "document_id").sortWithinPartitions("arrived_at").write.parquet(source)
    build = lambda batch: staging.incident_facts(staging.extract(batch))

    def run(checkpoint):
        stream = jobs.read_new_files(spark, source, docs.schema, "*.parquet", files_per_batch=1)
        jobs.load_new(stream, target, checkpoint, "incident_number", build).awaitTermination()
        return sorted(r.incident_number for r in spark.read.parquet(target).select("incident_number").collect())

    first = run(state)
    want = sorted(r.incident_number for r in build(spark.read.parquet(source)).select("incident_number").collect())
    assert first == want and len(set(first)) == len(first)
    assert run(state) == want
    # the same batches again under a new checkpoint overwrite themselves
    assert run(state + uuid.uuid4().hex) == want


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    target = str(tmp_path / "out")
    rows = spark.range(500).select(F.col("id").cast("string").alias("key"), F.lit("x" * 50).alias("fact"))
    jobs.add_batch(rows, target, ["key"], 0, 16, new_only=True)
    key = rows.select("key").schema
    old = jobs.earlier(spark, target, key, [3, 7], 1)
    read = {f.split("bucket=")[1].split("/")[0] for f in old.inputFiles()}
    assert read == {"3", "7"}
    assert old.count() == rows.where(F.pmod(F.xxhash64("key"), F.lit(16)).isin(3, 7)).count()
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "fact" not in plan and "ReadSchema: struct<key:string>" in plan
    assert jobs.earlier(spark, target, key, [3], 0).count() == 0
    assert jobs.earlier(spark, str(tmp_path / "none"), key, [3], 1).count() == 0


def arrive(spark, folder, rows):
    spark.createDataFrame([(i, t, None) for i, t, _ in rows], "id long, text string, x string").drop("x").join(
        spark.createDataFrame([(i, d) for i, _, d in rows], "id long, day int"), "id"
    ).select("id", "text", F.timestamp_add("DAY", "day", F.lit("2024-01-01").cast("timestamp")).alias("arrived_at")).coalesce(1).write.mode("append").parquet(folder)


# (id, text, day) per file: late firsts, late copies, copies in one file, empty and null texts
FILES = [
    [(1, "a", 20), (2, "a", 20), (3, "", 20)],
    [(4, "b", 21)],
    [(5, "late first", 3), (6, "a", 2), (7, None, 22)],
    [(8, "late first", 23), (9, "b", 21), (10, None, 1), (11, "", 40)],
]


def test_intake_loses_no_late_first_copy(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(checkpoint=state):
        stream = jobs.hashed(jobs.read_new_files(spark, source, DOCS, files_per_batch=1), "text")
        jobs.intake(stream, target, checkpoint, "id", "arrived_at", buckets=4).awaitTermination()
        return {r.content_hash: (r.document_id, str(r.arrived_at)[:10], r.copies) for r in jobs.intake_state(spark, target).collect()}

    for rows in FILES:  # one run per file: the job is stopped and started again
        arrive(spark, source, rows)
        got = run()
        twin = jobs.batch_intake(jobs.hashed(spark.read.schema(DOCS).parquet(source), "text"), "id", "arrived_at")
        assert got == {r.content_hash: (r.document_id, str(r.arrived_at)[:10], r.copies) for r in twin.collect()}
    assert sorted(v[0] for v in got.values()) == [3, 4, 5, 6, 10]
    assert got[None] == (10, "2024-01-02", 1)
    assert run() == got


def test_intake_and_load_replayed_batches(spark, tmp_path):
    rows = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    more = spark.createDataFrame([("k2", 3), ("k3", 4)], "key string, v int")
    target = str(tmp_path / "out")
    for _ in range(2):
        jobs.add_batch(rows, target, ["key"], 0, 4, new_only=True)
        jobs.add_batch(more, target, ["key"], 1, 4, new_only=True)
    assert sorted(tuple(r) for r in jobs.loaded(spark, target).select("key", "v").collect()) == [("k1", 1), ("k2", 2), ("k3", 4)]


VALUES = [3.5, None, 1e9 + 0.25, 1e9 + 0.5, 1e9 + 0.75, 2.0, -7.25, 0.0]


@pytest.mark.parametrize("cut", [0, 1, 3, 8])
def test_merged_moments_are_those_of_all_rows(spark, cut):
    rows = [(k, v) for k in ("a", None) for v in VALUES]
    parts = [spark.createDataFrame(part, "k string, value double") for part in (rows[:cut], rows[cut:])]
    got = series.stats_of(series.merge_moments(*[series.moments(p, ["k"]) for p in parts], ["k"])).collect()
    want = {r.k: r for r in series.series_stats(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert {r.k for r in got} == set(want)
    for r in got:
        assert r._n == want[r.k]._n == 7
        assert r._mean == pytest.approx(want[r.k]._mean, rel=1e-12) and r._sd == pytest.approx(want[r.k]._sd, rel=1e-9)


def test_learnt_moments_restart_and_replay(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kind = "event_type string, t timestamp_ntz, value double"

    def run(checkpoint):
        hours = jobs.read_new_files(spark, source, kind, files_per_batch=1)
        jobs.metric_anomalies(hours, None, target, checkpoint, ["event_type"], learn=True).awaitTermination()
        return sorted((r.event_type, r.n, round(r.mean, 9), round(r.m2, 6)) for r in jobs.learnt_moments(spark, target).collect())

    hour = "make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_interval(0, 0, 0, 0, h)"
    for first in (0, 8, 16):
        spark.range(first, first + 8).selectExpr("id AS h").selectExpr(
            "if(h % 2 = 0, 'a', 'b') AS event_type", f"{hour.replace('h)', 'int(h))')} AS t", "if(h = 20, 500.0, double(h % 5)) AS value"
        ).coalesce(1).write.mode("append").parquet(source)
        got = run(state)
        twin = series.moments(spark.read.schema(kind).parquet(source), ["event_type"]).collect()
        assert got == sorted((r.event_type, r.n, round(r.mean, 9), round(r.m2, 6)) for r in twin)
    assert [(r.event_type, r.value) for r in spark.read.parquet(target).collect()] == [("a", 500.0)]
    # Without state of its own the job takes all batches again and overwrites what each has left.
    assert run(state + "-new") == got


def test_history_is_scanned_once(spark, tmp_path):
    target, state, source = (str(tmp_path / n) for n in ("out", "state", "in"))
    kind = "event_type string, t timestamp_ntz, value double"
    history = spark.createDataFrame([("a", float(i % 3)) for i in range(30)], "event_type string, value double")
    history.write.parquet(str(tmp_path / "history"))
    new = spark.createDataFrame([("a", 90.0)], "event_type string, value double").withColumn("t", F.lit("2024-01-01").cast("timestamp_ntz"))
    new.select("event_type", "t", "value").write.parquet(source)
    for again in range(2):
        if again:  # the history is gone, its moments are not
            history = spark.read.parquet(str(tmp_path / "history")).withColumn("value", F.raise_error(F.lit("scanned")).cast("double"))
            new.select("event_type", "t", "value").write.mode("append").parquet(source)
        hours = jobs.read_new_files(spark, source, kind)
        jobs.metric_anomalies(hours, history, target, state, ["event_type"]).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_topic_windows_are_those_of_the_batch(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-02 10:00:00"), ("b", "2024-01-02 11:00:00")], "topic string, at string")
    got = jobs.topic_windows(rows.select("topic", F.col("at").cast("timestamp").alias("created_at")), "2 days", "1 day")
    counts = {(str(r.window_start)[:10], r.topic): r.mentions for r in got.collect()}
    assert counts == {("2023-12-31", "a"): 1, ("2024-01-01", "a"): 2, ("2024-01-02", "a"): 1, ("2024-01-01", "b"): 1, ("2024-01-02", "b"): 1}
