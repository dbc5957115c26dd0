"""Document fingerprints by consistent weighted sampling.

Every (term, sample) pair owns three random numbers drawn from a hash of both: r and c from a
Gamma(2, 1) distribution and beta, uniform.  A term of weight w scores

    t = floor(ln w / r + beta),  ln a = ln c - r * (t - beta + 1)

and each sample keeps the term with the smallest a.  Two documents keep the same (term, t) with
probability equal to their generalised Jaccard similarity, the sum of the smaller weights over the
sum of the larger ones.  Terms are words, weights are their counts.  The kept ln a stands for the
(term, t) it came from: it is a function of both that different ones do not share in practice.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from signalbook.llm.common import staged, text_of, words

SAMPLES = 64
#: Quantiles in the tables of the Gamma distribution (a power of two); the lowest one of the table
#: for c, where the minima lie, is drawn again from a table of as many below it.
QUANTILES = 4096
BITS = QUANTILES.bit_length() - 1
BETA_BITS = 16


def gamma_quantile(p: float) -> float:
    """x with 1 - (1 + x) exp(-x) = p, the quantile of Gamma(2, 1), by bisection in the logarithm."""
    low, high = math.sqrt(2 * p) * 0.5, 4.0 - 4.0 * math.log1p(-p)
    for _ in range(80):
        middle = (low + high) / 2
        # the series keeps the digits that the closed form cancels when x is small
        mass = middle * middle / 2 - middle**3 / 3 + middle**4 / 8 if middle < 1e-3 else 1 - (1 + middle) * math.exp(-middle)
        low, high = (middle, high) if mass < p else (low, middle)
    return (low + high) / 2


def _tables(spark: SparkSession) -> dict[str, Column]:
    """Quantiles of r, logarithms of those of c and of c's lowest quantile, by column name.

    Each is a one-row subquery: a constant of fixed size that generated code reads as an array.
    """
    gamma = [gamma_quantile((i + 0.5) / QUANTILES) for i in range(QUANTILES)]
    tail = [gamma_quantile((i + 0.5) / QUANTILES**2) for i in range(QUANTILES)]
    tables = {"r_table": gamma, "log_c": [math.log(x) for x in gamma], "log_c_tail": [math.log(x) for x in tail]}
    constant = lambda values: F.from_json(F.lit(json.dumps(values)), "array<double>")
    return {name: spark.range(1).select(constant(values)).scalar() for name, values in tables.items()}


def _sample(i: int) -> Column:
    """The smallest ln a of the group for sample ``i``."""
    term, log_weight, r_table, log_c, log_c_tail = map(F.col, ("term", "log_weight", "r_table", "log_c", "log_c_tail"))
    h = F.xxhash64(term, F.lit(i))
    cut = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(QUANTILES - 1)).cast("int")
    r = F.get(r_table, cut(0))
    c_at = cut(BITS)
    ln_c = F.when(c_at == 0, F.get(log_c_tail, cut(2 * BITS))).otherwise(F.get(log_c, c_at))
    beta = (F.shiftrightunsigned(h, 64 - BETA_BITS) + F.lit(0.5)) / F.lit(float(2**BETA_BITS))
    # weight 1 (ln w = 0) needs no division: t is then floor(beta) = 0
    t = F.when(log_weight == 0.0, F.lit(0.0)).otherwise(F.floor(log_weight / r + beta).cast("double"))
    return F.min(ln_c - r * (t - beta + F.lit(1.0))).alias(f"m{i}")


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and ``signature`` (array<int>, one number per sample) of every row's ``text``.

    ``keys`` identify a row.  If ``texts`` is partitioned by some of them, no row moves again.  A text
    without words has the signature of the empty set: all zeros.
    """
    terms = (
        texts.select(*keys, F.explode_outer(words(text_of("text"))).alias("word"))
        .select(*keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "term", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log(F.col("n"))).alias("log_weight"))
        .withColumns(_tables(texts.sparkSession))
    )
    least = terms.groupBy(*keys).agg(*[_sample(i) for i in range(samples)], F.count("term").alias("terms"))
    short = [F.xxhash64(f"m{i}").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for i in range(samples)]
    return least.select(
        *keys, F.when(F.col("terms") > 0, F.array(*short)).otherwise(F.array(*[F.lit(0)] * samples)).alias("signature")
    )


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.aggregate(
        F.zip_with(one, other, lambda a, b: (a == b).cast("int")), F.lit(0), lambda total, hit: total + hit
    ) / F.size(one)


def printed(signature: Column) -> Column:
    """The signature as a string of 8 hex digits per sample."""
    return F.array_join(F.transform(signature, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def in_order(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """``rows`` with the fields of the row before and after it in the order, as structs prev and next.

    The order wraps round.  Rows are dealt out by range and written, so that every task orders one
    range; the ends of the ranges are joined through one row per range.
    """
    ranges = staged(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    fields_of = F.struct(*fields)
    inside = Window.partitionBy("range").orderBy(*order)
    ends = ranges.groupBy("range").agg(
        F.min_by(fields_of, F.struct(*order)).alias("first"), F.max_by(fields_of, F.struct(*order)).alias("last")
    )
    whole = Window.partitionBy()
    by_range = Window.orderBy("range")
    ends = ends.select(
        "range",
        F.coalesce(F.lag("last").over(by_range), F.max_by("last", "range").over(whole)).alias("before"),
        F.coalesce(F.lead("first").over(by_range), F.min_by("first", "range").over(whole)).alias("after"),
    )
    return (
        ranges.join(ends, "range")
        .withColumn("prev", F.coalesce(F.lag(fields_of).over(inside), F.col("before")))
        .withColumn("next", F.coalesce(F.lead(fields_of).over(inside), F.col("after")))
        .drop("range", "before", "after")
    )


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next per row.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as
    many, or all, of the next document's; documents are ordered by id (null first) and then, should
    an id occur twice, by a hash of the text; the last one's next is the first.  Whole numbers as ids
    become long, others are taken as texts and ordered bytewise.  Rows that repeat an
    id and text are one document, returned as often as it occurs.  A null text is the empty text.
    """
    kind = "long" if isinstance(docs.schema[id_col].dataType, IntegralType) else "string"
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast(kind), F.lit("0").cast(kind)).alias("id"),
        F.col(f"`{id_col}`").isNull().alias("no_id"),
        text_of(text_col).alias("text"),
    )
    key = ["id", "no_id", "text_key"]
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    slim = rows.select(*key, F.length("text").cast("long").alias("n_chars")).groupBy(*key).agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    ordered = slim.select((~F.col("no_id")).alias("has_id"), *key, "n_chars", "rows")
    ordered = staged(in_order(ordered, ["has_id", "id", "text_key"], [*key, "n_chars"]), "in-order")
    texts = rows.repartition(*key).groupBy(*key).agg(F.first("text").alias("text"))
    heads = (
        texts.join(ordered.select(*key, "prev"), key)
        .select(
            *[F.col(f"prev.{k}").alias(k) for k in key],
            F.expr("substring(text, 1, cast(prev.n_chars div 2 as int))").alias("head"),
        )
    )
    both = texts.join(heads, key).select(
        *key,
        "text",
        F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 2 as int))"), "head").alias("edited"),
    )
    variants = both.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("variant"), F.col("text").alias("text"), F.lit(None).cast("binary").alias("sha")),
                F.struct(F.lit(1).alias("variant"), F.col("edited").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")),
            )
        ).alias("v"),
    ).select(*key, "v.variant", "v.text", "v.sha")
    signed = signatures(variants, [*key, "variant", "sha"], samples)
    signed = staged(
        signed.groupBy(*key).agg(
            F.max(F.when(F.col("variant") == 0, F.col("signature"))).alias("signature"),
            F.max(F.when(F.col("variant") == 1, F.col("signature"))).alias("edited_signature"),
            F.lower(F.hex(F.max("sha"))).alias("edited_sha256"),
        ),
        "signatures",
    )
    following = signed.select(*[F.col(k).alias(f"next_{k}") for k in key], F.col("signature").alias("next_signature"))
    placed = ordered.select(*key, "n_chars", "rows", *[F.col(f"next.{k}").alias(f"next_{k}") for k in key])
    return (
        placed.join(signed, key)
        .join(following, [f"next_{k}" for k in key])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            "signature",
            "edited_signature",
            likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
            likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
        )
    )
