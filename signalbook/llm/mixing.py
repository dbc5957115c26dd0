"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, once per epoch.  A document's virtual finish time
is the words its source has queued up to its end, divided by the source's target; documents of all
sources are sorted by that time over the whole corpus and the sequence is cut at the total budget.

Running sums are taken over pieces of the shuffle order (see ``running_total``), so a source that
holds a third of the corpus is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbook.llm.common import free_name, running_total, staged, text_of, words

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
EPOCHS = 2
#: Rows in one piece of a running sum.
PIECE_ROWS = 4096
HASH_RANGE = 2**32


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] | Mapping[str, float] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    epochs: int = EPOCHS,
) -> DataFrame:
    """One row per source: source, source_size, source_rows, target, budget, all_rows.

    ``sizes`` has source, size and rows (how often the row occurs).  Weights are given by name, or as
    a sequence dealt out in turn to the sources in code point order, null last.  The budget is shared
    by weight; no target exceeds ``epochs`` times its source's size, the excess is shared again by
    weight among the rest.  The level at which that ends is found in one ordered pass over sources.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("source_rows")
    )
    if isinstance(weights, Mapping):
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight: Column = F.coalesce(table[F.col("source")].cast("double"), F.lit(1.0))
    else:
        turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    sources = (
        sources.withColumn("weight", weight)
        .withColumn("budget", F.lit(float(budget_share)) * F.sum("source_size").over(everything))
        .withColumn("all_rows", F.sum("source_rows").over(everything))
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    sources = sources.withColumn("level", level)
    sources = sources.withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    )
    return sources.select(
        "source",
        "source_size",
        "source_rows",
        F.least("cap", F.col("level") * F.col("weight")).alias("target"),
        "budget",
        "all_rows",
    )


def _pieces(rows: Column) -> Column:
    return F.ceil(rows / F.lit(PIECE_ROWS)).cast("long")


KEYS = ["queue", "key", "size"]


def _queue(source: Column) -> Column:
    """Null-free form of the source for joining: '=name', or the empty string for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _copies(place: str) -> Column:
    """How often the row at a place among equal rows is taken: in the epochs that reach it."""
    return F.coalesce(F.size(F.filter("goes", lambda g: g >= F.col(place))), F.lit(0))


def _schedule(
    docs: DataFrame,
    weights: Sequence[float] | Mapping[str, float] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    epochs: int = EPOCHS,
    seed: str = "",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes with their number of rows, sources with targets, and what is taken of each size entry.

    The last has KEYS, first_finish and goes: for every epoch how many of the equal rows go in.
    """
    size = F.size(words(text_of(text_col))).cast("long")
    sized = staged(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("rows")),
        "mix-sizes",
    )
    sources = source_targets(sized, weights, budget_share, epochs)
    queue = _queue(F.col("source"))
    queued = (
        sized.withColumn("queue", queue)
        .join(sources.withColumn("queue", queue).drop("source"), "queue")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn(
            "place",
            F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))),
        )
        .withColumn("spot", F.conv(F.substring("place", 1, 8), 16, 10).cast("long"))
        .withColumn("piece", F.floor(F.col("spot") * _pieces(F.col("source_rows")) / HASH_RANGE))
    )
    order = ["place", "size"]
    queued = running_total(queued, ["queue"], ["epoch", "piece"], order, "words", "queued")
    room = F.floor((F.col("target") - F.col("queued")) / F.col("size") + F.lit(0.5))
    fits = F.when(F.col("size") == 0, F.when(F.col("epoch") == 1, F.col("rows")).otherwise(0)).otherwise(
        F.least(F.greatest(room, F.lit(0)), F.col("rows"))
    )
    eligible = (
        queued.withColumn("fits", fits.cast("long"))
        .where("fits > 0")
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("queued") + F.col("fits") * F.col("size")) / F.col("target")).otherwise(0.0))
        .withColumn("words", F.col("size") * F.col("fits"))
        .withColumn("piece", F.floor(F.log2(F.lit(1.0) + F.col("finish")) * _pieces(F.col("all_rows") * epochs)))
    )
    cut = running_total(eligible, [], ["piece"], ["finish", "queue", *order], "words", "ahead")
    left = F.floor((F.col("budget") - F.col("ahead")) / F.col("size"))
    cut = cut.withColumn(
        "goes",
        F.when(F.col("size") == 0, F.col("fits")).otherwise(F.least(F.greatest(left, F.lit(0)), F.col("fits"))).cast("long"),
    ).where("goes > 0")
    taken = (
        cut.withColumn("key", _key(F.col("doc_id")))
        .groupBy(*KEYS)
        .agg(F.collect_list("goes").alias("goes"), F.min("finish").alias("first_finish"))
    )
    return sized, sources, taken


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, copies, taken, first_finish.

    size counts the words; copies says how often the mix takes the document (0 to ``epochs``) and
    taken how many words that is.  A document goes in whole or not at all.  The one that straddles
    its source's target goes in if at least half of it lies below, so each source ends within its
    largest document of its target.  The order is a hash of seed, epoch and id, so reruns agree.
    A null text has size 0; a document without words costs nothing and is taken once.  Repeated
    rows queue one behind the other.  An empty table gives no rows.
    """
    sized, sources, taken = _schedule(docs, **settings)
    rows = (
        sized.withColumns({"queue": _queue(F.col("source")), "key": _key(F.col("doc_id"))})
        .join(sources.withColumn("queue", _queue(F.col("source"))).drop("source"), "queue")
        .join(taken, KEYS, "left")
        .withColumn("place", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .withColumn("copies", F.when(F.col("goes").isNull(), 0).otherwise(_copies("place")).cast("int"))
    )
    return rows.select(
        "doc_id",
        "size",
        "source",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        "first_finish",
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken.

    Rows with the same id, source and size take their copies in turn.  Join and row number share one
    partitioning, so a text moves once.
    """
    id_col, source_col, text_col = (settings.get(f"{k}_col", d) for k, d in (("id", "doc_id"), ("source", "source"), ("text", "text")))
    _, _, taken = _schedule(docs, **settings)
    names = {name: free_name(docs, f"_mix_{name}") for name in (*KEYS, "goes", "place", "again")}
    marked = docs.select(
        "*",
        _queue(F.col(f"`{source_col}`")).alias(names["queue"]),
        _key(F.col(f"`{id_col}`")).alias(names["key"]),
        F.size(words(text_of(text_col))).cast("long").alias(names["size"]),
    )
    on = [names[k] for k in KEYS]
    goes, place = names["goes"], names["place"]
    taken = taken.select(*[F.col(k).alias(names[k]) for k in (*KEYS, "goes")])
    copies = F.size(F.filter(goes, lambda g: g >= F.col(place)))
    return (
        marked.join(taken, on)
        .withColumn(place, F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(0))))
        .where(copies > 0)
        .withColumn(names["again"], F.explode(F.sequence(F.lit(1), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
