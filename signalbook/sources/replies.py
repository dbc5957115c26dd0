"""Reading JSON replies of a text model into fields, entities and sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.text import strip
from signalbook.functions.values import half_up

FIELDS = "array<struct<field:string,value:string,confidence:double,text_span:string>>"
ENTITIES = "array<struct<type:string,value:string,confidence:double>>"
TEXTS = ["sentiment", "category", "subcategory", "summary"]
LISTS = ["topics", "key_phrases"]


def reply_text(raw: Column) -> Column:
    """The JSON part of a reply: without code fences, else the widest block in braces."""
    trimmed = strip(raw)
    lines = F.split(trimmed, "\n", -1)
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    clean = F.when(F.startswith(trimmed, F.lit("```")), inner).otherwise(trimmed)
    block = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(valid(clean), valid(block))


def _at(value: Column, name: str, dtype: str) -> Column:
    """A property of a semi-structured value, null if it is missing or of another kind."""
    return F.try_variant_get(value, f"$.{name}", dtype)


def _text_at(value: Column, name: str) -> Column:
    """As text; a list or an object stays as its JSON."""
    whole = _at(value, name, "variant")
    return F.when(~F.is_variant_null(whole), F.coalesce(_at(value, name, "string"), F.to_json(whole)))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def _objects(value: Column, name: str) -> Column:
    """The objects of a list; anything else in it, or in its place, is left out."""
    listed = F.coalesce(_at(value, name, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(listed, _is_object)


def reply_of(value: Column) -> Column:
    """The known properties of a reply by typed paths; others stay in the value, wrong kinds are null."""
    return F.when(
        _is_object(value),
        F.struct(
            F.transform(
                _objects(value, "fields"),
                lambda f: F.struct(
                    _at(f, "field", "string").alias("field"),
                    _text_at(f, "value").alias("value"),
                    _at(f, "confidence", "double").alias("confidence"),
                    _at(f, "text_span", "string").alias("text_span"),
                ),
            ).alias("fields"),
            F.transform(
                _objects(value, "entities"),
                lambda e: F.struct(
                    _at(e, "type", "string").alias("type"),
                    _text_at(e, "value").alias("value"),
                    _at(e, "confidence", "double").alias("confidence"),
                ),
            ).alias("entities"),
            _at(value, "sentiment_score", "double").alias("sentiment_score"),
            *[_at(value, name, "string").alias(name) for name in TEXTS],
            *[_at(value, name, "array<string>").alias(name) for name in LISTS],
        ),
    )


def _place(source: Column, span: Column) -> Column:
    """0-based start of the span in the text, -1 when it is not there, null without a span."""
    return F.when(span != "", F.call_function("locate", span, source) - 1)


def read_replies(replies: DataFrame, raw: str, text: str) -> DataFrame:
    """The rows with the reply as ``_r`` (null if it cannot be read), its placed fields, its entities
    and the mean confidence of its fields."""
    default = F.lit(fv.FIELD_CONFIDENCE["reply_default"])
    source = F.col(text)
    landed = replies.withColumn("_v", F.try_parse_json(reply_text(F.col(raw))))
    reply = landed.withColumn("_r", reply_of(F.col("_v"))).drop("_v")
    given = F.coalesce(F.col("_r.fields"), F.array().cast(FIELDS))
    placed = F.transform(
        given,
        lambda f: F.struct(
            F.coalesce(f.field, F.lit("unknown")).alias("field"),
            f.value.alias("value"),
            F.coalesce(f.confidence, default).alias("confidence"),
            f.text_span.alias("text_span"),
            _place(source, f.text_span).alias("char_start"),
            F.when(
                _place(source, f.text_span) >= 0,
                _place(source, f.text_span) + F.length(f.text_span),
            ).alias("char_end"),
        ),
    )
    none = F.lit(None)
    mood = F.array(
        F.struct(
            F.lit("sentiment").alias("field"),
            F.col("_r.sentiment").alias("value"),
            F.coalesce(F.col("_r.sentiment_score"), default).alias("confidence"),
            F.substring(source, 1, 200).alias("text_span"),
            none.cast("int").alias("char_start"),
            none.cast("int").alias("char_end"),
        )
    )
    fields = F.when(F.col("_r.sentiment").isNotNull(), F.concat(placed, mood)).otherwise(placed)
    entities = F.transform(
        F.coalesce(F.col("_r.entities"), F.array().cast(ENTITIES)),
        lambda e: F.struct(
            F.coalesce(e.type, F.lit("unknown")).alias("type"),
            F.coalesce(e.value, F.lit("")).alias("value"),
            F.coalesce(e.confidence, default).alias("confidence"),
        ),
    )
    total = F.aggregate("fields", F.lit(0.0), lambda a, f: a + f.confidence)
    return (
        reply.withColumns({"fields": fields, "entities": entities})
        .withColumn(
            "overall_confidence",
            half_up(F.when(F.size("fields") > 0, total / F.size("fields")).otherwise(default), 2),
        )
    )


def parse_replies(replies: DataFrame, key: str, raw: str, text: str) -> DataFrame:
    """One row per reply with placed fields, entities, sentiment and mean confidence."""
    return read_replies(replies, raw, text).select(
        key, F.col("_r").isNotNull().alias("parsed"), "fields", "entities", "overall_confidence"
    )
