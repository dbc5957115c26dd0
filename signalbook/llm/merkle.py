"""Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

Rows are leaves; the leaves of a group, in order, are hashed by runs of ``fanout`` until one node is
left, the group's subroot; the subroots in turn give the root.  The manifest stores one record per
different node: its digest and the digests of its children.

A proof is found by descent: a request (group, rank of the leaf) starts at the root; the digits of its
rank, most significant first, say which child of the record it follows, and the children it does not
follow are collected.  The collected segments, reversed, are the proof from leaf to root.  Requests
under one node descend as one row until their digits part, so the work is that of the nodes touched.

Ranks are counted over a range partitioning of all rows, so a hot group is no larger task than others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalbook.session import scratch_path

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id that count inside a partition.
PLACE_BITS = 33
PATH = "array<struct<left:string,right:string>>"


class Manifest(NamedTuple):
    """The stored tables; all lie below one folder, see :func:`build` and :func:`open_manifest`."""

    #: id, leaf, the carried columns, tree (number of the group), height, rank.
    leaves: DataFrame
    #: group, tree, size, height, subroot.
    trees: DataFrame
    #: For each level from 1 the nodes: tree, height, rank, digest, children.
    levels: list[DataFrame]
    #: The same over the subroots, which form one tree.
    top: list[DataFrame]
    #: One row with the root, none for an empty table.
    root: DataFrame
    fanout: int


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def node_digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _digits(count: Column, fanout: int) -> Column:
    """Levels of a tree of ``count`` leaves: the digits of its last rank, none for a lone leaf."""
    return F.when(count <= 1, 0).otherwise(F.length(F.conv((count - 1).cast("string"), 10, fanout))).cast("int")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(df: DataFrame, order: Sequence[Column], name: str, path: str) -> DataFrame:
    """``df`` with its place (from 0) in the order of all rows, stored at ``path``.

    Rows are cut into ranges; a row's place is its place in the range plus the rows of the ranges
    before.  A row number breaks ties, so even equal rows are spread over ranges.
    """
    tie = f"_{name}_tie"
    spot, part = f"_{name}_spot", f"_{name}_part"
    order = [*order, F.col(tie)]
    placed = _stored(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(spot, F.monotonically_increasing_id())
        .drop(tie),
        path,
    ).withColumn(part, F.shiftright(spot, PLACE_BITS))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: their number is a setting, so one task orders them and the list may be broadcast.
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.select(part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.col(spot).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col("_start") + inside).drop(spot, part, "_start")


def _grow(nodes: DataFrame, height: int, fanout: int, path: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, height, rank, digest), each stored before the next."""
    levels = []
    for level in range(1, height + 1):
        run = F.struct((F.col("rank") % fanout).alias("digit"), "digest")
        grown = (
            nodes.where(F.col("height") >= level)
            .groupBy("tree", "height", F.expr(f"rank div {fanout}").alias("rank"))
            .agg(F.array_sort(F.collect_list(run)).alias("_run"))
            .select("tree", "height", "rank", F.col("_run.digest").alias("children"))
            .select("tree", "height", "rank", node_digest(F.col("children")).alias("digest"), "children")
        )
        nodes = _stored(grown, f"{path}/{level}")
        levels.append(nodes)
    return levels


def _tops(nodes: DataFrame, levels: Sequence[DataFrame]) -> DataFrame:
    """tree and the digest of its one node at its own height."""
    ends = nodes.where("height = 0").select("tree", F.col("digest").alias("subroot"))
    for level, above in enumerate(levels, 1):
        ends = ends.unionByName(above.where(F.col("height") == level).select("tree", F.col("digest").alias("subroot")))
    return ends


def build(
    docs: DataFrame,
    group: str = "lang",
    order: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    carry: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
    path: str | None = None,
) -> Manifest:
    """The manifest of all rows, stored below ``path`` (a new folder of the shared store by default).

    A leaf hashes the ``fields`` of a row; a null field is ``-``, so it differs from an empty one.
    Groups are ordered by value, null first; inside a group leaves ascend by ``order`` (null first),
    ties by digest; repeated rows are leaves of their own.  ``carry`` names columns computed from
    ``docs`` that stay with the leaf.  Other columns are ignored; an empty table has no root.  Texts
    are hashed whole and never moved.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "merkle")
    own = lambda name: F.col(f"`{name}`")
    leaves = docs.select(
        own(group).alias("group"),
        own(order).alias("id"),
        leaf_digest([own(name) for name in fields]).alias("digest"),
        *[column.alias(name) for name, column in (carry or {}).items()],
    )
    placed = _ranked(leaves, [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest")], "at", f"{path}/placed")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = _stored(
        _ranked(groups, [F.col("first")], "tree", f"{path}/groups").withColumn("height", _digits(F.col("size"), fanout)),
        f"{path}/sizes",
    )
    mine = trees.select(F.col("group").alias("_group"), "tree", "height", "first")
    _stored(
        placed.join(mine, F.col("group").eqNullSafe(F.col("_group")))
        .withColumn("rank", F.col("at") - F.col("first"))
        .drop("group", "_group", "at", "first"),
        f"{path}/leaves",
    )
    leaves = spark.read.parquet(f"{path}/leaves")
    height = trees.agg(F.max("height")).first()[0] or 0
    levels = _grow(leaves.select("tree", "height", "rank", "digest"), height, fanout, f"{path}/level")
    subroots = _stored(
        trees.join(_tops(leaves, levels), "tree").select("group", "tree", "size", "height", "subroot"), f"{path}/trees"
    )
    many = subroots.agg(_digits(F.count(F.lit(1)), fanout)).first()[0]
    _grow(_top_nodes(subroots, many), many, fanout, f"{path}/top")
    return open_manifest(spark, path, fanout)


def _top_nodes(trees: DataFrame, height: int) -> DataFrame:
    return trees.select(
        F.lit(0).cast("long").alias("tree"), F.lit(height).alias("height"), F.col("tree").alias("rank"), F.col("subroot").alias("digest")
    )


def open_manifest(spark: SparkSession, path: str, fanout: int = FANOUT) -> Manifest:
    """The manifest that :func:`build` stored below ``path``."""
    read = spark.read.parquet
    trees = read(f"{path}/trees")
    height, many = trees.agg(F.max("height"), _digits(F.count(F.lit(1)), fanout)).first()
    levels = [read(f"{path}/level/{k}") for k in range(1, (height or 0) + 1)]
    top = [read(f"{path}/top/{k}") for k in range(1, many + 1)]
    root = _tops(_top_nodes(trees, many), top).select(F.col("subroot").alias("root"))
    return Manifest(read(f"{path}/leaves"), trees, levels, top, root, fanout)


def records(manifest: Manifest) -> DataFrame:
    """The content-addressed store: one row per different inner node, digest and children."""
    nodes = None
    for level in (*manifest.levels, *manifest.top):
        nodes = level.select("digest", "children") if nodes is None else nodes.unionByName(level.select("digest", "children"))
    if nodes is None:
        nodes = manifest.root.select(F.col("root").alias("digest"), F.array().cast("array<string>").alias("children")).limit(0)
    return nodes.groupBy("digest").agg(F.first("children").alias("children"))


def _descend(seeds: DataFrame, levels: Sequence[DataFrame], requests: DataFrame, fanout: int) -> DataFrame:
    """Follow the requests (tree, rank and more) from the seeds (tree, height, digest, path) down.

    Returns the requests with the digest they reach and the path: per level the unselected children
    to the left and right of the selected one, root first.
    """
    demand = {1: requests}
    path = scratch_path(requests.sparkSession, "merkle-demand")
    for level in range(2, len(levels) + 1):
        wanted = demand[level - 1].select("tree", F.expr(f"rank div {fanout}").alias("rank")).distinct()
        demand[level] = _stored(wanted, f"{path}/{level}")
    arrived = None
    for level in range(len(levels), 0, -1):
        here = seeds.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("node"), "digest", "path")
        if arrived is not None:
            here = here.unionByName(arrived.select("tree", F.col("rank").alias("node"), "digest", "path"))
        record = levels[level - 1].groupBy("digest").agg(F.first("children").alias("children"))
        wanted = demand[level].withColumn("node", F.expr(f"rank div {fanout}"))
        digit = (F.col("rank") % fanout).cast("int")
        segment = F.struct(
            F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"),
            F.array_join(F.slice("children", digit + 2, F.lit(fanout)), "").alias("right"),
        )
        met = here.join(record, "digest").drop("digest").join(wanted, ["tree", "node"])
        # A rank beyond the last leaf asks for a child that does not exist.
        met = met.withColumn("digest", F.get("children", digit)).where(F.col("digest").isNotNull())
        kept = requests.columns if level == 1 else ["tree", "rank"]
        arrived = met.select(*kept, "digest", F.array_append("path", segment).alias("path"))
    alone = seeds.where("height = 0").select("tree", "digest", "path").join(requests.where("rank = 0"), "tree")
    alone = alone.select(*requests.columns, "digest", "path")
    return alone if arrived is None else arrived.unionByName(alone)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The requests (tree, rank and any columns but the following) with leaf, subroot, root and proof.

    proof lists, from the leaf to the root, the digests to the left and to the right of the node on
    the way.  A request for a rank that does not exist gives no row.
    """
    fanout = manifest.fanout
    no_path = F.array().cast(PATH).alias("path")
    many = len(manifest.top)
    first = manifest.root.first()
    root = F.lit(first["root"] if first else None).cast("string")
    start = manifest.root.select(
        F.lit(0).cast("long").alias("tree"), F.lit(many).alias("height"), F.col("root").alias("digest"), no_path
    )
    asked = requests.select("tree").distinct().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"))
    found = _descend(start, manifest.top, asked, fanout)
    heights = manifest.trees.select(F.col("tree").alias("rank"), "height")
    seeds = found.drop("tree").join(heights, "rank").select(F.col("rank").alias("tree"), "height", "digest", "path")
    if manifest.levels or manifest.top:
        seeds = _stored(seeds, scratch_path(requests.sparkSession, "merkle-seeds"))
    subroots = seeds.select("tree", F.col("digest").alias("subroot"))
    return (
        _descend(seeds, manifest.levels, requests, fanout)
        .withColumnRenamed("digest", "leaf")
        .withColumn("proof", F.reverse("path"))
        .drop("path")
        .join(subroots, "tree")
        .withColumn("root", root)
    )


def proof_text(proof: Column) -> Column:
    """All siblings of a proof in one string, level by level from the leaf, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
