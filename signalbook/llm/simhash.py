"""SimHash near-duplicates over an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most four bits share at least four of their eight bytes at
the same positions.  Posting lists of single bytes would hold N/256 fingerprints each, so the index
posts sets of three positional bytes: 20 such sets are enough for every choice of four positions to
contain one.  Within a posting list the shared positional bytes of each pair are tallied; pairs that
reach the guaranteed four are retained, and only these are verified by counting the bits that differ.

A list longer than ``LIST_ROWS`` is posted again under five longer keys (of five blocks of the open
bits, four differing bits leave one untouched), so no task meets a long list however large a group
of near copies is, and no pair is lost.  Of a list only links that join its fingerprints into groups
are kept, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook.llm.common import ascii_lower, by_value, keep_once, staged, text_of, words
from signalbook.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Fingerprints in a posting list before it is posted again under longer keys.
LIST_ROWS = 4096
#: Fingerprints compared with a list at a time inside a task.
BLOCK_ROWS = 256
LANES = 0x0000000100000001


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the raw text), fp: one row per row of ``docs``.

    A-Z are lowered, words are parted by ASCII white space, shingles count as often as they occur; a
    text with fewer words is one shingle and a text without words (or null) has fingerprint zero.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        words(ascii_lower(text)).alias("w"),
    )
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - shingle_words, F.lit(0))))
    hashes = rows.select("row", "doc_id", "text_key", "w", F.explode_outer(starts).alias("i")).select(
        "row",
        "doc_id",
        "text_key",
        F.when(
            F.col("i").isNotNull(),
            F.xxhash64(F.concat_ws(" ", *[F.get("w", F.col("i") + k) for k in range(shingle_words)])),
        ).alias("h"),
    )
    # Bits b and b + 32 are counted in the two halves of one sum.
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(LANES))).alias(f"s{b}") for b in range(32)]
    counted = hashes.groupBy("row", "doc_id", "text_key").agg(F.count("h").alias("n"), *sums)

    def bit(count: Column, place: int) -> Column:
        return F.when(count * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))

    fp = F.lit(0).cast("long")
    for b in range(32):
        fp = fp.bitwiseOR(bit(F.col(f"s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), b))
        fp = fp.bitwiseOR(bit(F.shiftrightunsigned(f"s{b}", 32), b + 32))
    return counted.select("doc_id", "text_key", F.coalesce(fp, F.lit(0)).alias("fp"))


def byte_sets() -> list[tuple[int, ...]]:
    """20 sets of three byte positions; any four positions contain one of them."""
    parts = ((0, 1, 2), (3, 4, 5), (6, 7))
    sets = [s for part in parts for s in combinations(part, 3)]
    for part, following in zip(parts, parts[1:] + parts[:1]):
        sets += [(*two, one) for two in combinations(part, 2) for one in following]
    return sets


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_masks() -> list[int]:
    return [_signed(sum(0xFF << (8 * p) for p in positions)) for positions in byte_sets()]


def longer_masks(mask: int) -> list[int]:
    """The key extended by each of five blocks of the bits it leaves open."""
    open_bits = [b for b in range(64) if not (mask >> b) & 1]
    blocks = [open_bits[i::5] for i in range(5)]
    return [_signed((mask & (2**64 - 1)) | sum(1 << b for b in block)) for block in blocks if block]


def _posted(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def shared_bytes(differ: np.ndarray) -> np.ndarray:
    """Positions at which two fingerprints have the same byte, from the bits that differ."""
    spread = differ | (differ >> np.uint64(4))
    spread |= spread >> np.uint64(2)
    spread |= spread >> np.uint64(1)
    return 8 - np.bitwise_count(spread & np.uint64(0x0101010101010101)).astype(np.int8)


def retained(differ: np.ndarray, max_bits: int) -> tuple[np.ndarray, ...]:
    """Places in ``differ`` of the linked pairs: tallied first, then verified by their bits.

    Only pairs that share the guaranteed number of positional bytes have their bits counted.  Pairs
    that merely share the three bytes of their list are most of a list of unlike texts, and end here.
    """
    enough = np.nonzero(shared_bytes(differ) >= 8 - max_bits)
    close = np.bitwise_count(differ[enough]) <= max_bits
    return tuple(places[close] for places in enough)


def linked(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest, other) that join the fingerprints of one list into their groups.

    Walks each group breadth first in blocks, so a list of n needs n rows times one block of memory.
    """
    left, right = [], []
    rest = np.sort(fps)
    while len(rest) > 1:
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            for at in range(0, len(frontier), BLOCK_ROWS):
                hit[retained(frontier[at : at + BLOCK_ROWS, None] ^ rest[None, :], max_bits)[1]] = True
            frontier, rest = rest[hit], rest[~hit]
            left.append(np.full(len(frontier), root))
            right.append(frontier)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _link_lists(max_bits: int):
    """Over rows sorted by list: the links of each list.  Holds one batch and one list at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = pd.concat([kept, batch]) if kept is not None else batch
            if not len(rows):
                continue
            mask, part = rows["mask"].to_numpy(), rows["part"].to_numpy()
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            last = new[-1] if len(new) else 0
            kept = rows.iloc[last:]  # the list may go on in the next batch
            if last:
                yield from _links(rows["fp"].to_numpy()[:last], np.concatenate([[0], new[:-1], [last]]), max_bits)
        if kept is not None and len(kept):
            yield from _links(kept["fp"].to_numpy(), np.array([0, len(kept)]), max_bits)

    return run


def _links(fp: np.ndarray, bounds: np.ndarray, max_bits: int) -> Iterator[pd.DataFrame]:
    fp = fp.astype(np.int64).view(np.uint64)
    length = np.diff(bounds)
    at = bounds[:-1][length == 2]
    close = at[retained(fp[at] ^ fp[at + 1], max_bits)]
    a, b = [fp[close]], [fp[close + 1]]
    for i in np.flatnonzero(length > 2):
        one, other = linked(fp[bounds[i] : bounds[i + 1]], max_bits)
        a.append(one)
        b.append(other)
    yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def links(fps: DataFrame, max_bits: int = MAX_BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """a, b: pairs of different fingerprints that connect all within ``max_bits`` of one another.

    ``fps`` has one column fp without repeats.  ``list_rows`` is at least 16.
    """
    masks = first_masks()
    found = None
    rows = _posted(fps, F.array(*[F.lit(m) for m in masks]))
    while True:
        lists = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n"))
        long_lists = staged(lists.where(F.col("n") > list_rows).select("mask", "part"), "long-lists")
        done = long_lists.isEmpty()
        short = rows if done else rows.join(long_lists, ["mask", "part"], "left_anti")
        some = (
            short.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInPandas(_link_lists(max_bits), "a long, b long").distinct()
        )
        some = staged(some, "near-links")
        found = some if found is None else found.unionByName(some)
        if done:
            return found
        longer = {m: longer_masks(m) for m in masks}
        masks = sorted({m for more in longer.values() for m in more})
        table = fps.sparkSession.createDataFrame(list(longer.items()), "mask long, more array<long>")
        rows = staged(
            _posted(rows.join(long_lists, ["mask", "part"], "left_semi").join(table, "mask"), F.col("more")).distinct(), "longer-keys"
        )


def near_groups(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    list_rows: int = LIST_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, fp, component_id: one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits
    (at most four).  Equal fingerprints always share a component; rows whose ids are all null have a
    null one.  An empty table gives no rows.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    rows = staged(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "different")
    roots = components(links(least.select("fp"), max_bits, list_rows))
    rooted = roots.join(least, roots["node"] == least["fp"])
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_linked = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    of_fp = least.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    # Written, so that the join below is one of two plain exchanges, whose hot partitions Spark splits.
    of_fp = staged(of_fp, "component-of")
    return rows.join(of_fp, "fp").select("doc_id", "text_key", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of ``docs`` per near-duplicate group, with all its columns: that of the smallest id.

    Null ids come last; of rows that agree in id and text one stays.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **settings)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    # Components without any id are kept apart by their fingerprint.
    kept = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("loose")).agg(first)
    kept = kept.select("first.doc_id", F.col("first.text_key").alias("key"))
    return keep_once(docs, kept, id_col, F.xxhash64(text_of(text_col)))


by_value(__name__)
