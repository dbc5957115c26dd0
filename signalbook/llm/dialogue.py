"""Chat formatting by rotating the perspective.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant and all others as named users.  A rendered dialogue is a sequence of segments with their
positions, one row each, so that a conversation of any length is spread over tasks: positions come
from running sums over pieces of the conversation.  The loss mask covers the assistant's words and
end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from signalbook.llm.common import staged

SYSTEM = "system"
END = "<|end|>\n"


def rotate(turns: DataFrame, system_role: str = SYSTEM) -> DataFrame:
    """conv_id, perspective, turn, place, speaker, head, body, start, mask_start, mask_end.

    One row per conversation, participant and turn; place numbers the turns from 0.  A segment is
    ``head`` (the tag of the speaker), ``body`` (the words and the end mark) and begins at code point
    ``start`` of the rendered dialogue; [mask_start, mask_end) is its part of the mask, null for
    others' segments.  Turns are ordered by turn, role and text (nulls last); repeated rows are said
    again.  ``system_role`` is no participant and opens as system.  A null role is the participant
    "unknown"; a null text is empty; a null conv_id is a conversation of its own.  A conversation of
    system turns only has no perspective and gives no rows.  Ids may be of any type: whole numbers
    become long, others stay as they are.  A turn that is not a number counts as null.
    """
    rows = turns.select(
        (F.col("conv_id").cast("long") if isinstance(turns.schema["conv_id"].dataType, IntegralType) else F.col("conv_id")).alias("conv"),
        F.col("turn").try_cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))  # no text stands for null
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("said")).withColumn("key", conv)
    order = [F.col("key"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    # Dealt out by conversation and turn, then written: a long conversation spans several ranges.
    dealt = staged(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "turns")
    body = F.concat("text", F.lit(END))
    who = dealt.where(F.col("role") != system_role).select("key", F.col("role").alias("perspective")).distinct()
    seen = (
        dealt.join(who, "key")
        .withColumn(
            "head",
            F.when(F.col("role") == system_role, F.lit("<|system|>\n"))
            .when(F.col("role") == F.col("perspective"), F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user:"), "role", F.lit("|>\n"))),
        )
        .withColumn("body", body)
        .withColumn("size", F.length("head") + F.length("body"))
        .withColumn("chars", F.col("size") * F.col("said"))
    )
    keys = ["key", "perspective", "range"]
    before = (Window.unboundedPreceding, -1)
    pieces = Window.partitionBy("key", "perspective").orderBy("range").rowsBetween(*before)
    starts = seen.groupBy(*keys).agg(F.sum("chars").alias("chars"), F.sum("said").alias("said")).select(
        *keys,
        F.coalesce(F.sum("chars").over(pieces), F.lit(0)).alias("from_char"),
        F.coalesce(F.sum("said").over(pieces), F.lit(0)).alias("from_place"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
    placed = (
        seen.join(starts, keys)
        .withColumn("start", F.col("from_char") + F.coalesce(F.sum("chars").over(inside), F.lit(0)))
        .withColumn("place", F.col("from_place") + F.coalesce(F.sum("said").over(inside), F.lit(0)))
        .withColumn("again", F.explode(F.sequence(F.lit(0), (F.col("said") - 1).cast("int"))))
        .withColumn("start", F.col("start") + F.col("again") * F.col("size"))
    )
    mine = F.col("role") == F.col("perspective")
    return placed.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        "turn",
        (F.col("place") + F.col("again")).alias("place"),
        F.col("role").alias("speaker"),
        "head",
        "body",
        "start",
        F.when(mine, F.col("start") + F.length("head")).alias("mask_start"),
        F.when(mine, F.col("start") + F.col("size")).alias("mask_end"),
    )


def assembled(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole dialogues, for conversations that fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("start", F.concat("head", "body").alias("text"), "mask_start", "mask_end")))
    return segments.groupBy("conv_id", "perspective").agg(ordered.alias("all")).select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("all", lambda s: s["text"]), "").alias("text"),
        F.transform(
            F.filter("all", lambda s: s["mask_start"].isNotNull()),
            lambda s: F.struct(s["mask_start"].alias("start"), s["mask_end"].alias("end")),
        ).alias("masks"),
    )
