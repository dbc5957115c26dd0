"""Exact duplicates by an extendible-hash index kept as files in the shared folder.

A text's key is a 64-bit hash of its normalised form.  The directory is made first, from the keys
alone: it doubles, a bit of the key at a time, as long as a cell holds more than ``capacity`` keys;
cells that need not be told apart share the bucket of a shorter prefix.  A bucket is a range of keys
and has one owner: the entries (a text, its largest id, its copies) are dealt to the tasks by bucket,
and the owner chains them.  Entries under one key are compared byte by byte; equal ones are merged
into one link, every different text adds a link.  Only there it is decided which rows are copies.

Each reading task sends a text at most once per lot (``LOTS``), so an owner of a text that a third of
all rows share receives as many entries of it as there are lots, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbook.llm.common import ascii_lower, keep_once, staged, text_of

#: Keys in a bucket before it splits.
BUCKET_KEYS = 8192
#: Lots in which the copies of a text are folded before its owner receives them.
LOTS = 16


def _cell(key_bits: int, bits: int) -> Column:
    """Cell of a key in a directory of ``bits`` bits: its leading bits."""
    return F.shiftrightunsigned("key", key_bits - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, bits: int) -> DataFrame:
    """The directory of ``bits`` bits over the different ``keys`` (column cell): cell, depth, bucket.

    A prefix of a cell is a bucket if it is not overfull (or is the whole cell) while the prefix above
    it is overfull.  depth is the number of its bits, bucket its first cell.
    """
    cells = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    prefixes = cells.select("cell", "n", depths).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    held = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = held.where((F.col("held") <= capacity) | (F.col("depth") == bits)).select("depth", "prefix")
    # Every prefix above the shortest one that fits is overfull.
    chosen = prefixes.join(fits, ["depth", "prefix"], "left_semi").groupBy("cell").agg(F.min("depth").alias("depth"))
    return chosen.withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)"))


def doubled(keys: DataFrame, capacity: int, bits: int = 0, key_bits: int = 64) -> int:
    """Bits of the directory after all doublings: the fewest from ``bits`` on at which no cell of the
    different ``keys`` (column key) is overfull.

    Starts at the bits that equally full buckets would need, so it takes few rounds; there is no
    deepest directory short of the whole key.  Cells number a few times the keys / ``capacity``.
    """
    bits = min(key_bits, max(bits, (max(keys.count() - 1, 0) // capacity).bit_length()))
    while bits < key_bits:
        held = keys.groupBy(_cell(key_bits, bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        if held.where(F.col("n") > capacity).isEmpty():
            break
        bits += 1
    return bits


def _key(text: Column, key_bits: int) -> Column:
    """Leading bits of the 64-bit hash; fewer bits only to make collisions in tests."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits)


def chains(source: DataFrame, capacity: int = BUCKET_KEYS, bits: int = 0, key_bits: int = 64) -> DataFrame:
    """The index of ``source`` (doc_id, norm, key): bucket, depth, key, link, text_sha256, keep_id, group_size.

    One row per different text; link counts the texts of a key from 1.
    """
    keys = staged(source.select("key").distinct(), "index-keys")
    bits = doubled(keys, capacity, bits, key_bits)
    buckets = staged(directory(keys.select(_cell(key_bits, bits).alias("cell")), capacity, bits), "directory")
    lots = source.withColumn("lot", F.spark_partition_id() % LOTS)
    entries = lots.groupBy("key", "norm", "lot").agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("rows"))
    owned = entries.withColumn("cell", _cell(key_bits, bits)).join(buckets, "cell").repartition("bucket")
    # A bucket lies whole in one task, so neither the grouping nor the numbering moves its rows again.
    texts = owned.groupBy("bucket", "depth", "key", "norm").agg(F.max("largest").alias("keep_id"), F.sum("rows").alias("group_size"))
    linked = texts.select("bucket", "depth", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    return staged(linked.withColumn("link", F.row_number().over(chain)), "exact-index")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_KEYS,
    bits: int = 0,
    key_bits: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth, link.

    Texts are equal when identical after lower-casing A-Z.  keep_id is the largest doc_id of the
    equal texts.  A null text counts as empty.  A null id is never the largest unless all are null.
    Of repeated rows with the same id and text, all count in group_size and one is kept.  An empty
    table gives no rows; columns other than id and text are ignored.  Rows look up their link by key
    and SHA-256, so that their texts do not move again.
    """
    norm = ascii_lower(text_of(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("key", _key(F.col("norm"), key_bits))
    index = chains(source, capacity, bits, key_bits)
    rows = (
        source.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("doc_id", "key", "text_sha256")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return (
        rows.join(index, ["key", "text_sha256"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
            "bucket",
            "depth",
            "link",
        )
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with the same id and text one."""
    groups = exact_groups(docs, id_col, text_col, **settings).where("kept")
    kept = groups.select("doc_id", F.col("text_sha256").alias("key"))
    return keep_once(docs, kept, id_col, F.sha2(ascii_lower(text_of(text_col)), 256))
