"""Resolving raw names to canonical entities: exact, normalised, fuzzy, new.

Mentions are reduced to distinct names first; every later step works on names.

Fuzzy matching finds every pair that reaches a score (see :mod:`similar`).  Names are taken in tiers
from the strictest score down, so most of them never meet the wide lower tier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.text import normalize_name, token_sorted
from signalbook.functions.values import lookup, stable_id
from signalbook.operators.components import connected
from signalbook.operators.similar import best_in_blocks, one_letter_less, ranked, same_words, similar_names
from signalbook.session import cut_lineage, exchanged

# --- registry ------------------------------------------------------------------


def name_table(registry: DataFrame) -> DataFrame:
    """Registry (entity_type, canonical_id, name, aliases) as one row per known name."""
    kept = ["entity_type", "canonical_id", F.col("name").alias("canonical_name")]
    own = registry.select(*kept, normalize_name(F.col("name")).alias("known"))
    alias = registry.select(*kept, F.explode("aliases").alias("_a")).select(
        "entity_type", "canonical_id", "canonical_name", normalize_name(F.col("_a")).alias("known")
    )
    return own.unionByName(alias).distinct()


def _one_candidate(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of several candidates the one with the smallest id."""
    return (
        matches.groupBy(*keys)
        .agg(F.min(F.struct("canonical_id", "canonical_name")).alias("_best"))
        .select(*keys, "_best.canonical_id", "_best.canonical_name")
    )


# --- exact and normalised --------------------------------------------------------


def resolve_exact(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Names equal to a canonical name except for case."""
    keys = ["entity_type", "raw_value"]
    known = registry.select(
        "entity_type",
        F.lower("name").alias("_lower"),
        "canonical_id",
        F.col("name").alias("canonical_name"),
    )
    matches = names.select(*keys, F.lower("raw_value").alias("_lower")).join(
        exchanged(known), ["entity_type", "_lower"]
    )
    return _one_candidate(matches, keys)


def resolve_normalized(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names whose normalised form equals a normalised name or alias."""
    keys = ["entity_type", "raw_value"]
    norm = F.col("norm") if "norm" in names.columns else normalize_name(F.col("raw_value"))
    matches = names.select(*keys, norm.alias("known")).join(exchanged(known), ["entity_type", "known"])
    return _one_candidate(matches, keys)


# --- fuzzy -------------------------------------------------------------------------


def best_fuzzy(
    norms: DataFrame,
    known: DataFrame,
    method: str = "indel",
    tiers: Sequence[float] = (85, 60),
) -> DataFrame:
    """Best partner of each distinct normalised name, by a score from the lowest tier on; ties go to the
    smallest id.

    A name with a partner in a strict step has its best partner there, so only the others go on: first
    names of the same words are met, then names that lack one letter, then scores down to halfway between
    two tiers, then the lowest.  All pairs of short names are told apart by bits faster than they are
    found by a common segment, which among made-up or short words is common to too many.
    """
    keys = ["entity_type", "norm"]
    # Scoring is costly and names are short: a fixed number of partitions keeps
    # adaptive execution from merging the work into a few tasks by size.
    spark = norms.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    dealt = norms.select(*keys).repartition(parts, *keys).distinct()
    asked = cut_lineage(dealt.withColumn("_a", token_sorted(F.col("norm"))).where("_a <> ''"))
    knows = ranked(known)
    on = ["entity_type", "_a"]
    rest = cut_lineage(asked.select(*on).distinct())
    lowest = [*((above + below) / 2 for above, below in zip(tiers, tiers[1:])), tiers[-1]]
    steps = [same_words, lambda *sides: one_letter_less(*sides, tiers[-1], method)]
    steps += [lambda *sides, least=least: best_in_blocks(*sides, least, method) for least in lowest]
    found = None
    for step in steps:
        first = F.min(F.struct((-F.col("score")).alias("s"), "_rank")).alias("_f")
        best = cut_lineage(step(rest, knows).groupBy(*on).agg(first).select(*on, "_f._rank", (-F.col("_f.s")).alias("score")))
        if step is not steps[-1]:
            rest = cut_lineage(rest.join(exchanged(best), on, "left_anti"))
        found = best if found is None else found.unionByName(best)
    named = found.join(exchanged(knows.select("entity_type", "_rank", "canonical_id", "canonical_name")), ["entity_type", "_rank"])
    return asked.join(exchanged(named), on).select(*keys, "canonical_id", "canonical_name", "score")


def _band(score: Column, part: int) -> Column:
    out = F.lit(None)
    for band in reversed(fv.FUZZY_BANDS):
        out = F.when(score >= band[0], F.lit(band[part])).otherwise(out)
    return out


# --- new entities and the whole cascade ----------------------------------------------


def new_canonical_id(entity_type: Column, norm: Column, raw: Column) -> Column:
    """Prefix by type and the whole hash of type and normalised name: the same on every run."""
    seed = F.when(norm != "", norm).otherwise(F.lower(raw))
    return F.concat(
        lookup(fv.ENTITY_PREFIXES, entity_type, "ENT"), F.lit("_"), F.upper(stable_id(entity_type, seed))
    )


def distinct_names(mentions: DataFrame, order: str) -> DataFrame:
    """One row per distinct raw name: where it came first and how often it came."""
    # Mentions without a name are a group that counts none.  A filter on the name would go below what
    # makes the name, and make it twice.
    return (
        mentions.groupBy("entity_type", "raw_value")
        .agg(F.min(order).alias("first_seen"), F.count("raw_value").alias("n_mentions"))
        .where("n_mentions > 0")
    )


def linked_forms(forms: DataFrame, link: float, method: str) -> tuple[DataFrame, DataFrame]:
    """Groups of similar new names: (form, root) and (form, score of its best link).

    ``forms`` has entity_type, norm and form (the id the name would have alone).
    """
    known = forms.select(
        "entity_type", F.col("norm").alias("known"), F.col("form").alias("canonical_id"), F.col("norm").alias("canonical_name")
    )
    own = forms.select("entity_type", "norm", "form")
    pairs = similar_names(own.select("entity_type", "norm"), known, link, method).join(exchanged(own), ["entity_type", "norm"])
    pairs = cut_lineage(pairs.where(F.col("form") != F.col("canonical_id")).select("form", "canonical_id", "score"))
    roots = connected(pairs.select(F.col("form").alias("a"), F.col("canonical_id").alias("b")))
    return roots.withColumnRenamed("node", "form"), pairs.groupBy("form").agg(F.max("score").alias("link_score"))


def grown(fresh: DataFrame, link: float | None, method: str) -> DataFrame:
    """New names with the entity each belongs to, and the score of the link that brought it there.

    Names of the same normalised form are one.  With ``link`` forms as similar as that, directly or
    over others, are one entity as well, whatever order they came in; it is named by the mention seen
    first and has that form's id.  link_score is null for the forms that give the entity its name.
    """
    fresh = fresh.withColumn("form", new_canonical_id(F.col("entity_type"), F.col("norm"), F.col("raw_value")))
    if link is None:
        fresh = fresh.withColumn("root", F.col("form")).withColumn("link_score", F.lit(None).cast("double"))
    else:
        fresh = cut_lineage(fresh)
        forms = cut_lineage(fresh.where("norm <> ''").select("entity_type", "norm", "form").distinct())
        roots, scores = linked_forms(forms, link, method)
        fresh = fresh.join(exchanged(roots), "form", "left").join(exchanged(scores), "form", "left")
        fresh = fresh.withColumn("root", F.coalesce("root", "form"))
    first = fresh.groupBy("entity_type", "root").agg(F.min(F.struct("first_seen", "raw_value", "form")).alias("_f"))
    named = first.select("entity_type", "root", F.col("_f.raw_value").alias("canonical_name"), F.col("_f.form").alias("canonical_id"))
    own = F.col("form") == F.col("canonical_id")
    return fresh.join(exchanged(named), ["entity_type", "root"]).withColumn("link_score", F.when(~own, F.col("link_score"))).drop("root", "form")


def resolve_names(
    names: DataFrame, registry: DataFrame, method: str = "indel", tiers: Sequence[float] = (85, 60), link: float | None = None
) -> DataFrame:
    """Decide every distinct name: exact, then normalised, then fuzzy, then new.

    New names with the same normalised form are one new entity, named by the form seen first.  With
    ``link`` new names as similar as that are one as well (see :func:`grown`): the other forms are
    fuzzy matches of the entity, by the score of their best link.
    """
    keys = ["entity_type", "raw_value"]
    # Names are read by every step below: store them (normalised) once, however
    # much work lies behind the mentions.
    names = cut_lineage(names.withColumn("norm", normalize_name(F.col("raw_value"))))
    known = cut_lineage(name_table(registry))
    exact = resolve_exact(names, registry)
    after_exact = names.join(exchanged(exact), keys, "left_anti")
    same = resolve_normalized(after_exact, known)
    remain = after_exact.join(exchanged(same), keys, "left_anti")
    fuzzy = best_fuzzy(remain, known, method, tiers)
    tried = remain.join(exchanged(fuzzy), ["entity_type", "norm"], "left")
    matched = tried.filter(F.col("canonical_id").isNotNull())
    fresh = tried.filter(F.col("canonical_id").isNull()).drop("canonical_id", "canonical_name", "score")
    new = grown(fresh, link, method)

    def decided(df: DataFrame, method_name, confidence, is_new, review, score) -> DataFrame:
        return df.select(
            *keys,
            "canonical_id",
            "canonical_name",
            F.lit(method_name).alias("resolution_method") if isinstance(method_name, str) else method_name.alias("resolution_method"),
            confidence.alias("confidence"),
            F.lit(is_new).alias("is_new_entity"),
            review.alias("requires_review"),
            score.alias("score"),
        )

    no, zero, score, by_link = F.lit(False), F.lit(0.0), F.col("score"), F.col("link_score")
    return (
        decided(exact, "exact", F.lit(fv.EXACT_CONFIDENCE), False, no, zero)
        .unionByName(decided(same, "normalized", F.lit(fv.NORMALIZED_CONFIDENCE), False, no, zero))
        .unionByName(
            decided(matched, _band(score, 2), _band(score, 1), False, _band(score, 3), score)
        )
        .unionByName(
            decided(new.where("link_score IS NULL"), "new_entity", F.lit(fv.NEW_ENTITY_CONFIDENCE), True, no, zero)
        )
        .unionByName(
            decided(new.where("link_score IS NOT NULL"), _band(by_link, 2), _band(by_link, 1), False, _band(by_link, 3), by_link)
        )
    )


def resolve_mentions(mentions: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision of every single mention (the resolution log)."""
    return mentions.join(exchanged(decisions), ["entity_type", "raw_value"])


def new_entities(decisions: DataFrame) -> DataFrame:
    """Entities to insert, one row each."""
    return (
        decisions.filter("is_new_entity")
        .select("entity_type", "canonical_id", "canonical_name", "confidence")
        .distinct()
    )


def aliases(decisions: DataFrame) -> DataFrame:
    """Every raw form that differs from the canonical name, one row per form."""
    return decisions.filter(F.col("raw_value") != F.col("canonical_name")).select(
        "entity_type", "canonical_id", F.col("raw_value").alias("alias")
    ).distinct()


def ambiguous(log: DataFrame) -> DataFrame:
    """Review items for decisions that need a person."""
    return log.filter("requires_review").select(
        F.lit("entity_resolution").alias("item_type"),
        "document_id",
        F.concat(F.lit("Ambiguous entity: '"), "raw_value", F.lit("'")).alias("title"),
        F.concat(
            F.lit("May match '"), "canonical_name", F.lit("' (confidence: "),
            F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%)"),
        ).alias("description"),
        F.col("raw_value").alias("current_value"),
        F.col("canonical_id").alias("suggested_value"),
        "confidence",
        F.lit("medium").alias("priority"),
    )
