"""The extendible-hash index: chains inside buckets, doubling until no bucket is overfull, one owner per bucket."""

import collections
import random

from pyspark.sql import functions as F

from signalbook.llm import exact


def brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").lower()].append(doc_id)
    return {(i, t): (max(ids), len(ids)) for t, ids in groups.items() for i in ids}


def docs_of(spark, n=600, texts=90):
    draw = random.Random(5)
    rows = [(i, draw.choice((f"text {draw.randrange(texts)}", f"TEXT {draw.randrange(texts)}", "hot", None))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def test_chains_under_few_keys(spark):
    rows, docs = docs_of(spark)
    want = brute(rows)
    text_of = dict(rows)
    for key_bits in (1, 4, 64):
        got = exact.exact_groups(docs, capacity=1 if key_bits == 1 else 3, key_bits=key_bits).collect()
        assert {(r["doc_id"], (text_of[r["doc_id"]] or "").lower()): (r["keep_id"], r["group_size"]) for r in got} == want
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len({t for _, t in want})
        links = {r["text_sha256"]: (r["bucket"], r["link"]) for r in got}
        assert len(links) == len({t for _, t in want}) == len({(r["text_sha256"], r["link"]) for r in got})
        if key_bits == 1:  # two keys, two chains
            assert sorted(collections.Counter(b for b, _ in links.values())) == [0, 1]
            for bucket in (0, 1):
                chain = sorted(link for b, link in links.values() if b == bucket)
                assert chain == list(range(1, len(chain) + 1))


def test_doubling_stops_when_no_bucket_is_overfull(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    for capacity in (40, 700, 3000):
        bits = exact.doubled(keys, capacity)
        cells = keys.select(exact._cell(64, bits).alias("cell"))
        buckets = exact.directory(cells, capacity, bits)
        held = cells.join(buckets, "cell").groupBy("bucket").count().collect()
        assert sum(r["count"] for r in held) == 3000 and max(r["count"] for r in held) <= capacity
        assert bits == 0 or capacity < 3000
    assert exact.doubled(keys.limit(0), 5) == 0


def test_owner_chains_without_another_shuffle(spark, monkeypatch):
    plans = []
    write = exact.staged

    def seen(df, name):
        if name == "exact-index":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(exact, "staged", seen)
    _, docs = docs_of(spark, 50)
    exact.exact_groups(docs).count()
    above = plans[0].split("REPARTITION_BY_COL")[0]
    assert above.count("Exchange") == 1 and "Window" in above  # only that of the owners
