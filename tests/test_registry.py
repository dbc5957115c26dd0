"""Components of new names and the registry kept from run to run, on small name sets."""

import random

import pytest
from pyspark.sql import functions as F

from signalbook.operators import components, registry, resolve
from signalbook.session import scratch_path

MENTION = "entity_type string, raw_value string, at int"
BASE = [("customer", "C1", "Acme Corp", ["Acme Global"]), ("customer", "C2", "Blue Ocean Bank", None)]


def names(spark, mentions):
    rows = [("customer", m, i) for i, m in enumerate(mentions)]
    return resolve.distinct_names(spark.createDataFrame(rows, MENTION), "at")


def base(spark, rows=BASE):
    return spark.createDataFrame(rows, registry.ROW)


def plain_components(links):
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in root if any(n in p for p in links if p[0] != p[1])}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none", "loops"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(shape)
    node = lambda i: f"n{i:03}"
    links = {
        "chain": [(node(i), node(i + 1)) for i in range(60)],
        "star": [(node(7), node(i)) for i in range(40) if i != 7],
        "random": [(node(rng.randrange(120)), node(rng.randrange(120))) for _ in range(70)],
        "none": [],
        "loops": [("a", "a"), ("b", "c"), ("c", "b"), ("b", "c")],
    }[shape]
    got = components.connected(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r["node"]: r["root"] for r in got} == plain_components(links)
    assert len(got) == len({r["node"] for r in got})


def test_new_names_in_a_chain_are_one_entity(spark):
    # The ends are not alike; each is like its neighbour.  The second mention comes first in the alphabet.
    chain = ["Wayne Zorks", "Wayne Zorkshop", "Wyne Zorkshops", "Wyne Zrkshopss"]
    decided = resolve.resolve_names(names(spark, [*chain, "Quux", "wayne zorks ltd", "Ltd."]), base(spark), link=80).collect()
    got = {r["raw_value"]: r for r in decided}
    assert len({got[n]["canonical_id"] for n in chain}) == 1
    assert all(got[n]["canonical_name"] == "Wayne Zorks" for n in [*chain, "wayne zorks ltd"])
    assert got["Wayne Zorks"]["is_new_entity"] and got["wayne zorks ltd"]["is_new_entity"]
    assert [got[n]["is_new_entity"] for n in chain[1:]] == [False] * 3
    assert got["Wayne Zorkshop"]["resolution_method"] == "fuzzy" and got["Wayne Zorkshop"]["score"] >= 80
    assert got["Quux"]["canonical_name"] == "Quux" and got["Ltd."]["is_new_entity"]
    # The order of arrival names the entity but does not change who belongs to it.
    turned = resolve.resolve_names(names(spark, chain[::-1]), base(spark), link=80).collect()
    assert {r["canonical_name"] for r in turned} == {"Wyne Zrkshopss"}
    apart = resolve.resolve_names(names(spark, chain), base(spark)).collect()
    assert len({r["canonical_id"] for r in apart}) == 4


def content(spark, path, version=None):
    return {r["canonical_id"]: (r["name"], r["aliases"]) for r in registry.read(spark, path, version).collect()}


def test_two_runs_equal_one_run_over_both(spark):
    first = ["ACME CORP", "Acme, Inc.", "Wayne Works", "Blue Ocean Bnk"]
    second = ["wayne works Ltd", "Stark Industries", "Bank Blue Ocean", "ACME CORP"]
    two, one = scratch_path(spark, "registry"), scratch_path(spark, "registry")
    for path in (two, one):
        assert registry.create(base(spark), path, buckets=4) == 1
    for run in (first, second):
        registry.merge(resolve.resolve_names(names(spark, run), registry.read(spark, two)), two)
    registry.merge(resolve.resolve_names(names(spark, first + second), registry.read(spark, one)), one)
    assert content(spark, two) == content(spark, one)
    assert content(spark, two)["C2"] == ("Blue Ocean Bank", ["Bank Blue Ocean", "Blue Ocean Bnk"])
    assert registry.current_version(spark, two) == 3
    assert content(spark, two, 1)["C1"] == ("Acme Corp", ["Acme Global"])
    # Nothing new: the same decisions again change nothing.
    again = resolve.resolve_names(names(spark, ["Wayne Works"]), registry.read(spark, two))
    before = content(spark, two)
    registry.merge(again, two)
    assert content(spark, two) == before


def test_an_alias_of_one_run_decides_in_the_next(spark):
    path = scratch_path(spark, "registry")
    registry.create(base(spark), path)
    registry.merge(resolve.resolve_names(names(spark, ["Blue Ocan Bak"]), registry.read(spark, path)), path)
    (next_run,) = resolve.resolve_names(names(spark, ["blue ocan bak"]), registry.read(spark, path)).collect()
    assert (next_run["canonical_id"], next_run["resolution_method"]) == ("C2", "normalized")


def test_failed_run_leaves_the_old_version(spark):
    path = scratch_path(spark, "registry")
    registry.create(base(spark), path, buckets=2)
    before = content(spark, path)
    broken = resolve.resolve_names(names(spark, ["New One", "Other One"]), registry.read(spark, path)).withColumn(
        "canonical_name", F.raise_error(F.lit("lost")).cast("string")
    )
    with pytest.raises(Exception, match="lost"):
        registry.merge(broken, path)
    # A list that was begun and not finished does not count either.
    spark.range(1).write.parquet(f"{path}/versions/2")
    fs = spark._jvm.org.apache.hadoop.fs
    done = fs.Path(f"{path}/versions/2/_SUCCESS")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, False)
    assert registry.current_version(spark, path) == 1 and content(spark, path) == before
    good = resolve.resolve_names(names(spark, ["New One"]), registry.read(spark, path))
    assert registry.merge(good, path) == 2
    assert len(content(spark, path)) == 3


def test_only_touched_buckets_are_written(spark):
    path = scratch_path(spark, "registry")
    many = [("customer", f"C{i:03}", f"Name {'x' * i}", []) for i in range(100)]
    registry.create(base(spark, many), path, buckets=16)
    registry.merge(resolve.resolve_names(names(spark, ["Quite Another"]), registry.read(spark, path)), path)
    old, new = (registry._list(spark, path, v) for v in (1, 2))
    assert sum(old[b] != new[b] for b in old) == 1
    assert len(content(spark, path)) == 101


def test_empty_registry_and_conflict(spark):
    path = scratch_path(spark, "registry")
    assert content(spark, path) == {}
    registry.create(base(spark, []), path)
    assert content(spark, path) == {}
    registry.merge(resolve.resolve_names(names(spark, ["First"]), registry.read(spark, path)), path)
    assert [n for n, _ in content(spark, path).values()] == ["First"]
    with pytest.raises(registry.VersionConflict):
        registry.create(base(spark), path)
